"""The stages of a run wired together: from annotation, sequences and alignments to results and report tables.

Every stage is a table in the run's folder with a record of what made it (`stages`). Stages that several modes share run
once; the results stage and those after it run for each mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators import calling, context, export, intervals, metagene, orfs, orfscan, psites, replicates, reports, results, transcripts
from codonlake.plans.stages import Stage
from codonlake.plans.stages import record as stage_record
from codonlake.plans.stages import run as run_stages
from codonlake.sources import bam, fasta, formats, inputs, offsets

#: The stages of a run in order; the optional one is left out unless asked for. Modes of resampling.
ORDER = ("orfscan", "psite", "qc", "dm", "abundance", "context", "codon", "visualize")
OPTIONAL = ("codon",)
MODES = {"accurate": ("accurate",), "fast": ("fast",), "both": ("accurate", "fast")}


@dataclass(frozen=True, kw_only=True)
class Config:
    """A sample's inputs and parameters."""

    sample: str
    folder: str
    gtf: str = ""
    fasta: str = ""
    alignments: str = ""
    length_offsets: Mapping[int, int] = field(default_factory=dict)
    offset_file: str = ""
    quality_file: str = ""
    mode: str = "accurate"
    starts: tuple[str, ...] = ("ATG",)
    min_aa: int = 6
    primary_only: bool = False
    chroms: tuple[str, ...] = ()
    max_transcripts: int | None = None
    collapse: bool = True
    merge_by: str = "blocks"
    min_mapq: int = 20
    rl: int | None = None
    min_cds_nt: int = 90
    min_density: float = 0.05
    template_codon_reads: int = 3
    least_a0: float = 0.5
    pi_method: str = "codon_equal"
    trim_fraction: float = 0.1
    trim_reservoir: int = 0
    settings: calling.Settings = calling.Settings()
    export: str = "credible"
    from_stage: str = ORDER[0]
    to_stage: str = ORDER[-1]
    with_codon: bool = False

    def checked(self) -> Config:
        """The same, if it can be run."""
        if not replicates_name(self.sample):
            raise ValueError("a sample needs a plain name")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if bool(self.length_offsets) == bool(self.offset_file):
            raise ValueError("either lengths with offsets or a file of offsets is wanted")
        if self.quality_file and not self.offset_file:
            raise ValueError("a file of quality counts needs one of offsets")
        if bad := [s for s in (self.from_stage, self.to_stage) if s not in ORDER]:
            raise ValueError(f"unknown stages: {', '.join(bad)}")
        if ORDER.index(self.from_stage) > ORDER.index(self.to_stage):
            raise ValueError("the first stage comes after the last")
        if not self.collapse and ORDER.index(self.to_stage) >= ORDER.index("dm"):
            raise ValueError("results need genomic ORFs")
        if isinstance(self.chroms, str) or isinstance(self.starts, str):
            raise ValueError("contigs and start codons are lists of names")
        if self.pi_method not in ("codon_equal", "read_weighted", "trimmed") or not 0 <= self.trim_fraction < 0.5 or self.trim_reservoir < 0:
            raise ValueError("a parameter of the template is out of bounds")
        if self.merge_by not in ("blocks", "stop"):
            raise ValueError(f"unknown way to merge: {self.merge_by}")
        if self.min_aa < 1 or self.least_a0 <= 0 or not set("".join(self.starts)) <= set("ACGT"):
            raise ValueError("a parameter is out of bounds")
        return self


def replicates_name(name: str) -> bool:
    return bool(inputs.ID.fullmatch(name))


def _torf(spark: SparkSession, _: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    gtf = formats.read_gtf(spark, p["gtf"])
    contigs = fasta.whitelist(fasta.read_fai(spark, p["fasta"]), p["primary_only"])
    if p["chroms"]:
        contigs = contigs.filter(F.col("chrom").isin(*p["chroms"]))
    tx = transcripts.indexed(gtf, contigs)
    if p["max_transcripts"] is not None:  # the first of the file
        first = gtf.filter("feature <> 'gene'").groupBy("transcript_id").agg(F.min("line").alias("line")).join(tx.select("transcript_id"), "transcript_id").orderBy("line").limit(p["max_transcripts"])
        tx = tx.join(first.select("transcript_id"), "transcript_id", "left_semi")
    pieces = fasta.read_contigs(spark, p["fasta"], p["chroms"]) if p["chroms"] else fasta.read_fasta(spark, p["fasta"])
    tx = fasta.splice(pieces, tx)
    return orfscan.in_order(orfscan.torfs(tx, tuple(p["starts"]), p["min_aa"]), gtf)


def _gorf(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return orfs.collapse(orfscan.for_collapse(tables["torf"]), p["merge_by"])


def _members(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return orfs.members(orfscan.for_collapse(tables["torf"]), p["merge_by"])


def _audit(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    """How far ORFs, members and genomic ORFs cover each other; anything left over stops the run."""
    found = orfs.audit(orfscan.for_collapse(tables["torf"]), tables["gorf_members"], tables["gorf"])
    if not orfs.passed(found):
        raise ValueError("genomic ORFs and their members don't cover the ORFs")
    return found


def _offsets(spark: SparkSession, _: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    if p["length_offsets"]:
        return psites.explicit_offsets(spark, {int(k): int(v) for k, v in p["length_offsets"].items()})
    main, _other = offsets.parse_offsets(offsets.read_text(spark, p["offset_file"]))
    if not p["quality_file"]:
        return psites.override_offsets(offsets.support(spark, main), sorted(main))
    reads, found, *_rest = offsets.parse_quality(offsets.read_text(spark, p["quality_file"]))
    return psites.select_offsets(offsets.support(spark, main, reads, found))


def _psite(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    if p["alignments"].endswith(".bam"):
        reads = bam.read(spark, p["alignments"], p["chroms"])
    else:
        reads = formats.read_sam(spark, p["alignments"])
        reads = reads.filter(F.col("rname").isin(*p["chroms"])) if p["chroms"] else reads
    chosen = tables["offsets"].filter("selected = 1").select(F.col("length").cast("int").alias("length"), F.col("offset").cast("int").alias("offset"))
    if chosen.isEmpty():
        raise ValueError("no read length passed")
    out = psites.records(psites.call(reads, chosen, p["min_mapq"]))
    return out if p["rl"] is None else out.filter(F.col("RL") == p["rl"])


def site_counts(psite: DataFrame) -> DataFrame:
    x = psite.select(F.col("rname").alias("chrom"), F.when(F.col("flag") == 16, "-").otherwise("+").alias("strand"), F.col("pos0").alias("pos"))
    return intervals.site_index(x)


def _cds(torf: DataFrame, p: Mapping) -> DataFrame:
    x = torf.withColumn("blocks", inputs.blocks(F.col("blockSizes"), F.col("genomic_block_starts1")))
    x = x.withColumn("sizes", F.transform("blocks", lambda b: b["e"] - b["s"])).withColumn("starts1", F.transform("blocks", lambda b: b["s"] + 1))
    x = metagene.load_cds(x, p["min_cds_nt"]).filter("skip is null")
    flank = lambda f: inputs.ranges(F.col(f"{f}_genomic_starts1"), F.col(f"{f}_genomic_ends1")).alias(f)
    return x.select(F.col("torf_id").alias("orf"), "gene_id", "gene_name", "transcript_id", "chrom", "strand", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("length"), "blocks", flank("flank5"), flank("flank3"))


def _cds_hits(tables: Mapping[str, DataFrame], p: Mapping, window: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    cds = _cds(tables["torf"], p)
    hits = intervals.range_join(site_counts(tables["psite"]), metagene.spliced_windows(cds, window)).select("orf", "t", "n", "length")
    inside = hits.filter("t >= 0 and t < length")
    dense = metagene.dense_enough(inside, cds.select("orf", "length"), p["min_density"]).select("orf")
    return cds.join(dense, "orf"), hits.join(dense, "orf"), inside.join(dense, "orf")


def _metrics(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    cds, hits, _inside = _cds_hits(tables, p)
    return metagene.full_metrics(hits, cds.drop("blocks", "flank5", "flank3"))


def _background(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    cds, _hits, inside = _cds_hits(tables, p)
    codons = intervals.codon_counts(inside.withColumn("n_codons", F.expr("length div 3"))).join(cds.select("orf", "length"), "orf")
    used = metagene.patterns(codons, least_reads=p["template_codon_reads"])
    if p["pi_method"] == "trimmed":
        n = used.filter(F.expr(f"c0 + c1 + c2 >= {int(p['template_codon_reads'])}")).agg(F.count(F.lit(1)).alias("n_codons"))
        found = metagene.trimmed_template(used, p["trim_fraction"], p["template_codon_reads"]) if not p["trim_reservoir"] else metagene.reservoir_template(used, p["trim_reservoir"], p["trim_fraction"], p["template_codon_reads"])
        rows = found.crossJoin(F.broadcast(n)).collect()  # one row each
    else:
        rows = metagene.template(used, p["template_codon_reads"]).filter(F.col("method") == p["pi_method"]).collect()  # one row
    pi = tuple(float(rows[0][f"pi{f}"] or 0.0) for f in range(3)) if rows else (0.0, 0.0, 0.0)
    if not sum(pi):
        raise ValueError("no codon of a template is left")
    row = spark.createDataFrame([(*pi, rows[0].n_codons)], "pi0 double, pi1 double, pi2 double, n_codons long")
    return metagene.background(row, metagene.fit_a0(used, pi, p["template_codon_reads"]), p["least_a0"]).withColumn("pi_method", F.lit(p["pi_method"]))


def _results(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    found = {k: "" if v is None else str(v) for k, v in tables["background"].first().asDict().items()}
    pi, a0 = inputs.background(found, p["pi_method"], p["least_a0"])
    s = calling.Settings(**{**p["settings"], "blocks": tuple(p["settings"]["blocks"]), "mode": p["mode"]})
    torf = tables["torf"].join(tables["gorf_members"].withColumnRenamed("torf", "torf_id"), "torf_id")
    rows, _reasons = calling.load(torf, s)
    return calling.call(rows, calling.counted(rows, site_counts(tables["psite"])), pi, a0, s)


def _abundance(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    r = tables["results"]
    rows = r.select("candidate", F.col("candidate").alias("id"), "n_core_codons", F.col("core_reads").alias("reads"), F.col("lambda_hat").alias("lambda"), F.col("lambda_profile_ci95_low").alias("ci_low"), F.col("lambda_profile_ci95_high").alias("ci_high"), F.col("model_expected_host_cds_core_reads").alias("host_reads"))
    return reports.quantify(rows, inputs.library_size(tables["psite"]))


def _context(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    torf = tables["torf"].join(tables["gorf_members"].withColumnRenamed("torf", "torf_id"), "torf_id")
    known = inputs.relevant(torf, tables["results"])
    numbers = lambda c: F.transform(F.split(c, ","), lambda v: v.cast("long"))
    path = context.translation_path(numbers("genomic_block_starts1"), numbers("genomic_block_ends1"), F.col("strand"), F.col("peptide_len").cast("long"))
    return context.context(tables["results"], known.withColumn("path", path))


def _selected(tables: Mapping[str, DataFrame], p: Mapping) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = export.selected(tables["results"], selection=p["export"])
    each = tables["torf"].join(rows.select("torf_id", "candidate_key"), "torf_id").withColumn("blocks", F.transform(inputs.blocks(F.col("blockSizes"), F.col("genomic_block_starts1")), lambda b: F.struct(b["s"].alias("start0"), b["e"].alias("end0"))))
    flat = each.select(F.col("candidate_key").alias("orf"), "chrom", "strand", F.expr("aggregate(blocks, 0L, (a, b) -> a + b.end0 - b.start0) div 3").alias("n_codons"), F.posexplode("blocks").alias("block", "b")).select("orf", "chrom", "strand", "n_codons", "block", "b.start0", "b.end0")
    codons = intervals.codon_counts(intervals.range_join(site_counts(tables["psite"]), intervals.with_offsets(flat)))
    codons = codons.join(flat.select("orf", "n_codons").distinct(), "orf").withColumnRenamed("orf", "candidate_key")
    core = export.core(codons, p["settings"]["first_codons"], p["settings"]["last_codons"])
    export.checked(export.reconciled(rows, core))
    return rows, core, each


def _codons(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    _rows, core, each = _selected(tables, p)
    return export.codon_rows(core, each)


def _ternary(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return export.ternary_rows(_selected(tables, p)[1])


def _summary(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return export.summaries(_selected(tables, p)[1])


def _plot(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return results.plot_data(results.points(tables["context"]))


def _lengths(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return results.length_table(results.points(tables["context"]))


def _waterfall(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
    return results.waterfall(results.points(tables["context"]), tables["context"].count())


def stages(c: Config) -> list[tuple[str, str, Stage]]:
    """(stage of the order, mode or empty, table to make) of a run."""
    c = c.checked()
    p = asdict(c)
    pick = lambda *names: {n: p[n] for n in names}
    qc = pick("min_cds_nt", "min_density", "template_codon_reads", "least_a0", "pi_method", "trim_fraction", "trim_reservoir")
    out = [
        ("orfscan", "", Stage("torf", _torf, (), pick("gtf", "fasta", "starts", "min_aa", "primary_only", "chroms", "max_transcripts"), (*orfscan.COLUMNS, "line"), True, ("gtf", "fasta"), shared=True, unique=("torf_id",))),
        ("orfscan", "", Stage("gorf", _gorf, ("torf",), pick("merge_by"), ("gorf_id", "gorf_signature"), shared=True, unique=("gorf_id",))),
        ("orfscan", "", Stage("gorf_members", _members, ("torf",), pick("merge_by"), ("gorf_id", "torf"), shared=True, unique=("torf",))),
        ("orfscan", "", Stage("gorf_audit", _audit, ("torf", "gorf_members", "gorf"), {}, ("metric", "value"), shared=True)),
        ("psite", "", Stage("offsets", _offsets, (), pick("length_offsets", "offset_file", "quality_file"), psites.AUDIT, True, ("offset_file", "quality_file"), ("length_offsets", "offset_file", "quality_file"))),
        ("psite", "", Stage("psite", _psite, ("offsets",), pick("alignments", "min_mapq", "rl", "chroms"), ("rname", "pos0", "RL"), True, ("alignments",), ("alignments",))),
        ("qc", "", Stage("cds_metrics", _metrics, ("torf", "psite"), qc, ("orf", "PIF"))),
        ("qc", "", Stage("background", _background, ("torf", "psite"), qc, ("pi0", "pi1", "pi2", "A"))),
    ]
    named = lambda mode, name: f"{mode}_{name}"

    def own(mode: str, name: str, make, needs: Sequence[str], parameters: Mapping, columns: Sequence[str] = ()) -> Stage:
        mine = {"results", "context"}

        def of_mode(spark: SparkSession, tables: Mapping[str, DataFrame], p: Mapping) -> DataFrame:
            return make(spark, {n.removeprefix(f"{mode}_"): t for n, t in tables.items()}, p)

        return Stage(named(mode, name), of_mode, tuple(named(mode, n) if n in mine else n for n in needs), {**parameters, "make": make.__name__}, columns)

    for mode in MODES[c.mode]:
        with_mode = {**pick("settings", "pi_method", "least_a0"), "mode": mode}
        out += [
            ("dm", mode, own(mode, "results", _results, ("torf", "gorf_members", "psite", "background"), with_mode, ("candidate", "q_BH", "classification"))),
            ("abundance", mode, own(mode, "abundance", _abundance, ("results", "psite"), {}, ("id", "status", "pfpkm"))),
            ("context", mode, own(mode, "context", _context, ("torf", "gorf_members", "results"), {}, ("gene_level_orf_class",))),
            *[("codon", mode, own(mode, n, f, ("torf", "psite", "results"), pick("export", "settings"), ("candidate_key",))) for n, f in (("codons", _codons), ("ternary", _ternary), ("summary", _summary))],
            *[("visualize", mode, own(mode, n, f, ("context",), {})) for n, f in (("plot_data", _plot), ("length_table", _lengths), ("gate_waterfall", _waterfall))],
        ]
    lo, hi = ORDER.index(c.from_stage), ORDER.index(c.to_stage)
    kept = [s for s in out if (s[0] not in OPTIONAL or c.with_codon) and (c.collapse or s[2].name not in ("gorf", "gorf_members", "gorf_audit"))]
    wanted = {s[2].name for s in kept if lo <= ORDER.index(s[0]) <= hi}
    if not wanted:
        raise ValueError("no stage is left to run")
    return [s for s in kept if ORDER.index(s[0]) <= hi]


def run(spark: SparkSession, c: Config, force: bool = False, dry: bool = False, shared: str | None = None) -> list[tuple[str, str]]:
    """(table, what was done with it) of a sample's run. Stages before the first asked for must be there. shared as in `stages.run`."""
    made = stages(c)
    first = next(s.name for stage, _, s in made if ORDER.index(stage) >= ORDER.index(c.from_stage))
    return run_stages(spark, f"{c.folder}/{c.sample}", [s for _, _, s in made], first=first, force=force, dry=dry, shared=shared)


def summary_row(spark: SparkSession, c: Config, mode: str, status: str) -> dict[str, str]:
    """What a batch's summary tells of one sample; blank where a table isn't there."""
    from pyspark.errors import AnalysisException

    def read(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{c.folder}/{c.sample}/{name}/data")
        except AnalysisException:
            return None

    found = {"replicate_id": c.sample, "mode": mode, "status": status}
    sites, chosen, back, res = read("psite"), read("offsets"), read("background"), read(f"{mode}_results")
    found["psite_alignments"] = "" if sites is None else str(sites.count())
    found["selected_length_offsets"] = "" if chosen is None else inputs.selected_text(chosen)
    row = back.first() if back is not None else None
    found |= {k: "" if row is None else f"{row[c0]:.10g}" for k, c0 in (("qc_frame0_prop", "pi0"), ("qc_A0", "A"))}
    found["candidates"] = "" if res is None else str(res.count())
    found["primary_credible"] = "" if res is None else str(res.filter("primary_credible_call = 1").count())
    return found


def run_batch(spark: SparkSession, configs: Sequence[Config], force: bool = False) -> list[dict[str, str]]:
    """Several samples: one that fails doesn't stop the others. A row for each sample and mode, errors in its status.

    ORF tables are kept by what made them, so samples of the same annotation, sequences and parameters share one."""
    names = [c.sample.casefold() for c in configs]
    if len(set(names)) < len(names):
        raise ValueError("two samples have one name")
    out = []
    for c in configs:
        try:
            run(spark, c, force, shared=f"{c.folder}/annotation")
            status = "complete"
        except Exception as error:  # noqa: BLE001  any failure belongs to its sample alone
            status = f"failed: {type(error).__name__}: {error}".splitlines()[0]
        out += [summary_row(spark, c, mode, status) for mode in MODES.get(c.mode, ())]
    return out


def fitting(spark: SparkSession, configs: Sequence[Config], mode: str = "accurate") -> list[Config]:
    """The samples whose results are whole. Results that other code, parameters or ORFs made than the first sample's are an error."""
    found = [(c, stage_record(spark, f"{c.folder}/{c.sample}", f"{mode}_results")) for c in configs]
    found = [(c, r) for c, r in found if r is not None]
    for c, r in found[1:]:
        first, other = found[0]
        if r["signature"] != other["signature"]:
            why = [k for k in ("code", "parameters") if r[k] != other[k]] or ["ORFs or earlier stages"]
            raise ValueError(f"{c.sample} doesn't fit {first.sample}: {', '.join(why)}")
        if r["columns"] != spark.read.parquet(f"{c.folder}/{c.sample}/{mode}_results/data").columns:
            raise ValueError(f"the results of {c.sample} aren't those of their record")
    return [c for c, _ in found]


def integrate(spark: SparkSession, configs: Sequence[Config], mode: str = "accurate", least: int = 2, least_share: float = 0.5, fdr: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(rows, consensus) over the samples whose results are there, also those whose later stages failed."""
    rows, available = None, []
    for c in fitting(spark, configs, mode):
        one = replicates.load(spark.read.parquet(f"{c.folder}/{c.sample}/{mode}_results/data"), c.sample)
        rows = one if rows is None else rows.unionByName(one)
        available.append(c.sample)
    if rows is None:
        raise ValueError("no sample has results")
    return rows, replicates.integrate(rows, [c.sample for c in configs], available, least, least_share, fdr)


def integration(spark: SparkSession, configs: Sequence[Config], mode: str = "accurate", pure_only: bool = False, least: int = 2, least_share: float = 0.5, fdr: float = 0.05, most: int = 100) -> dict[str, DataFrame]:
    """The tables of an integration by name: rows, consensus with its context, counts, states, quantities and their correlations.

    A quantity of a candidate that the consensus doesn't have stops it. pure_only: only candidates that repeat no annotated CDS."""
    from pyspark.errors import AnalysisException

    names = [c.sample for c in configs]
    rows, consensus = integrate(spark, configs, mode, least, least_share, fdr)
    known, amounts, sizes = None, None, []
    for c in configs:
        base = f"{c.folder}/{c.sample}"
        try:
            seen = spark.read.parquet(f"{base}/{mode}_context/data").select(F.concat_ws("|", "gorf_id", "overlap_type").alias("candidate_key"), "gene_level_orf_class", "gene_level_pure_intorf_eligible")
            one = spark.read.parquet(f"{base}/{mode}_abundance/data").select(F.col("id").alias("candidate_key"), F.lit(c.sample).alias("replicate_id"), "status", F.col("pfpkm").alias("x"))
        except AnalysisException:
            continue
        known = seen if known is None else known.unionByName(seen)
        amounts = one if amounts is None else amounts.unionByName(one)
        sizes.append(summary_row(spark, c, mode, "complete"))
    out = {"long": rows}
    if known is not None:
        consensus = consensus.join(known.groupBy("candidate_key").agg(F.min("gene_level_orf_class").alias("gene_level_orf_class"), F.min("gene_level_pure_intorf_eligible").alias("gene_level_pure_intorf_eligible")), "candidate_key", "left")
        if pure_only:
            consensus, out["long"], out["excluded"] = replicates.pure_only(consensus, rows)
    out |= {
        "consensus": consensus, "labels": replicates.label_counts(consensus), "call_counts": replicates.call_counts(out["long"], names, fdr), "states": replicates.state_matrix(consensus, names, most), "states_by_pattern": replicates.state_matrix(consensus, names, most, True),
        "support": reports.support_combinations(out["long"].select(F.col("candidate_key").alias("key"), F.col("replicate_id").alias("replicate"), replicates.number(F.col("primary_credible_call")).alias("primary"))),
        "lambda_pairs": reports.pairwise(out["long"].select(F.col("candidate_key").alias("key"), F.col("replicate_id").alias("replicate"), F.col("lambda_hat").try_cast("double").alias("x")).filter("x is not null and not isnan(x)")),
    }
    if amounts is not None:
        if not pure_only and (lost := replicates.unexpected(amounts, consensus).limit(1).collect()):
            raise ValueError(f"a quantity of a candidate that the consensus lacks: {lost[0].candidate_key}")
        out["abundance"] = replicates.abundance_matrix(consensus, amounts, names)
        if len(names) > 1:
            out["abundance_correlations"] = replicates.matrix_correlations(out["abundance"], names)
        meta = spark.createDataFrame([(r["replicate_id"], r["psite_alignments"], r["qc_frame0_prop"], r["qc_A0"], r["selected_length_offsets"]) for r in sizes], "replicate_id string, psite_alignments string, qc_frame0_prop string, qc_A0 string, selected_length_offsets string")
        out["quality_labels"] = replicates.quality_labels(spark.createDataFrame([(n,) for n in names], "replicate_id string"), replicates.metadata(meta))
    return out


def replace_settings(c: Config, **changes) -> Config:
    """The run with other parameters, those of `calling.Settings` included."""
    inner = {k: v for k, v in changes.items() if k in calling.Settings.__dataclass_fields__}
    outer = {k: v for k, v in changes.items() if k not in inner or k in Config.__dataclass_fields__ and k != "mode"}
    if "mode" in changes:  # of the run; results take it from there
        inner.pop("mode")
        outer["mode"] = changes["mode"]
    return replace(c, **outer, settings=replace(c.settings, **inner)) if inner else replace(c, **outer)

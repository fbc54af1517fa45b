"""Candidates to results: counts, gates, fit, resampling and classes of one run, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept
from codonlake.operators import candidates, dm, draws, export, fdr, intervals, resample
from codonlake.sources.inputs import blocks


#: Ways to draw: numpy generators in Arrow batches, or counters in column expressions.
SAMPLERS = {"generator": resample.tails, "counters": draws.tails}


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    least_aa: int = 6
    primary_aa: int = 10
    least_core: int = 3
    least_active: int = 3
    least_reads: int = 15
    credible_active: int = 5
    credible_active_frac: float = 0.15
    residual_frac: float = 1 / 3
    first_codons: int = 1
    last_codons: int = 1
    separation: float = 0.05
    gate: float = 0.20
    engine: str = "adaptive_importance"
    mode: str = "accurate"
    reps: int = 999
    importance_reps: int = 9999
    fdr: float = 0.05
    lambda_min: float = 0.05
    farthest: float = 0.10
    by: str = "gorf"
    keep_confounded: bool = False
    mane_only: bool = False
    seed: int = 1
    blocks: tuple[int, ...] = field(default=())
    sampler: str = "generator"


def load(torfs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(candidates, reasons): one representative for each candidate, with its members, and rows by the filter they failed.

    torfs: the table of ORFs with gorf_id and line. A candidate's order is that of the first of its ORFs."""
    number = lambda c: F.col(c).try_cast("long")
    x = torfs.withColumns(
        {
            "torf": F.col("torf_id"), "gorf": F.coalesce("gorf_id", F.lit("")), "mane": number("has_MANE_Select_tag"), "is_annotated_cds": number("is_annotated_cds"), "peptide_len": number("peptide_len"), "blocks_01": blocks(F.col("blockSizes"), F.col("genomic_block_starts1")),
            "same_gene": F.col("intorf_shares_annotated_stop_same_gene"), "any_gene": F.col("intorf_shares_annotated_stop_any_gene"), "confounded": number("intorf_annotated_stop_confounded"), "blocks": F.concat_ws("|", "chrom", "strand", "genomic_block_starts1", "blockSizes"),
        }
    )
    x = x.withColumn("sizes", F.transform("blocks_01", lambda b: b["e"] - b["s"])).withColumn("starts1", F.transform("blocks_01", lambda b: b["s"] + 1))
    x = candidates.eligible(x).filter("use = 'candidate'").withColumn("overlap_type", candidates.overlap_type(number("t_start"), number("cds_first_t")))
    length = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    x = x.withColumn("length", length).withColumn("n_core_codons", F.expr("length div 3") - s.first_codons - s.last_codons).withColumn("reason", candidates.rejection(s.least_aa, s.least_core, s.mane_only))
    reasons = x.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    groups = candidates.grouped(x.filter("reason is null"), s.by, s.keep_confounded, True).select("candidate", F.col("line").alias("candidate_order"), F.col("representative").alias("torf_id"), F.col("n_members").alias("n_member_torfs"), F.col("members").alias("member_torf_ids_preview"))
    rows = x.filter("reason is null").drop("reason", "use", "line").join(groups, "torf_id").dropDuplicates(["candidate"])
    return rows, reasons


def counted(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """candidate, codon, n_codons, c0, c1, c2 of the codons with reads. sites: chrom, strand, pos, n."""
    each = rows.select(F.col("candidate").alias("orf"), "chrom", "strand", F.expr("length div 3").alias("n_codons"), F.posexplode("blocks_01").alias("block", "b")).select("orf", "chrom", "strand", "n_codons", "block", F.col("b.s").alias("start0"), F.col("b.e").alias("end0"))
    hits = intervals.range_join(sites, intervals.with_offsets(each))
    x = intervals.codon_counts(hits)
    return x.join(rows.select(F.col("candidate").alias("orf"), F.expr("length div 3").alias("n_codons")), "orf").withColumnRenamed("orf", "candidate")


def _along(obs: list[Column], host, trans) -> Column:
    """Place of a point's projection on the line from host to trans: 0 at the host, 1 at the other end, without bounds."""
    step = [t - h for h, t in zip(host, trans, strict=True)]
    dot = sum(((o - h) * d for o, h, d in zip(obs[1:], host[1:], step[1:], strict=True)), (obs[0] - host[0]) * step[0])
    return dot / F.nullif(F.lit(sum(d * d for d in step)), F.lit(0.0))


def _fitted(core: DataFrame, kind: str, pi: tuple[float, float, float], a0: float, s: Settings) -> DataFrame:
    """Breadth, geometry and fit of one overlap type's candidates that have enough data."""
    host, trans, dominant, unused = candidates.host_template(kind, pi), pi, 2 if kind == "F1" else 1, 1 if kind == "F1" else 2
    n = F.col("c0") + F.col("c1") + F.col("c2")
    z = ((F.col("c0") - n * host[0]) - (F.col(f"c{unused}") - n * host[unused])) / F.sqrt(dm.contrast_variance(n, host[0], host[unused], a0))
    one = core.groupBy("candidate").agg(F.count_if(z >= 0.5).alias("target_vs_unused_z05_codons"), *[F.sum(f"c{f}").alias(f"s{f}") for f in range(3)])
    total = F.col("s0") + F.col("s1") + F.col("s2")
    one = one.select("candidate", "target_vs_unused_z05_codons", *[(F.col(f"s{f}") / total).alias(f"pi_obs_{f}") for f in range(3)])
    obs = [F.col(f"pi_obs_{f}") for f in range(3)]
    g = dict(zip(("lambda_gain_raw", "lambda_drop_raw", "lambda_abs_diff", "lambda_rel_diff", "lambda_proj_clipped", "distance_to_mixture_segment"), dm.geometry(obs, host, trans, dominant), strict=False))
    one = one.select("*", *[c.alias(k) for k, c in g.items()], _along(obs, host, trans).alias("lambda_proj_raw"), (obs[0] - host[0]).alias("alt_frame_gain"), (obs[dominant] - host[dominant]).alias("host_frame_drop"), *[F.lit(host[f]).alias(f"pi_host_{f}") for f in range(3)], *[F.lit(trans[f]).alias(f"pi_trans_{f}") for f in range(3)])
    one = one.withColumn("mixture_geometry_consistent", F.when((F.col("lambda_abs_diff") < 0.10) & (F.col("lambda_rel_diff") < 0.30), 1).otherwise(0))
    fit = dm.fit_lambda(core, host, trans, a0, "candidate").select("candidate", "lambda_hat", F.col("lrt").alias("lrt_stat"), "p_asym", F.col("ci_low").alias("lambda_profile_ci95_low"), F.col("ci_high").alias("lambda_profile_ci95_high"))
    left = dm.projected_residuals(core.join(fit.select("candidate", "lambda_hat"), "candidate"), F.col("lambda_hat"), host, trans)
    lag = dm.lag1(left, "candidate").select("candidate", F.col("n_pairs").alias("lag1_consecutive_pairs"), F.col("lag1").alias("lag1_residual_autocorrelation"))
    return one.join(fit, "candidate").join(lag, "candidate", "left").withColumn("overlap_type", F.lit(kind))


def call(rows: DataFrame, codons: DataFrame, pi: tuple[float, float, float], a0: float, s: Settings = Settings()) -> DataFrame:
    """Results of all candidates, ordered families, classes and contract included. rows: `load`'s; codons: `counted`'s.

    Candidates with too little data, of templates too much alike, or too short keep their rows, with p 1."""
    core = export.core(codons.withColumnRenamed("candidate", "candidate_key"), s.first_codons, s.last_codons).withColumnRenamed("candidate_key", "candidate")
    n = F.col("c0") + F.col("c1") + F.col("c2")
    region = codons.groupBy("candidate").agg(F.sum(n).alias("orf_region_reads"))
    got = core.groupBy("candidate").agg(F.sum(n).alias("core_reads"), F.count_if(n > 0).alias("n_active_core_codons"), *[F.sum(f"c{f}").alias(f"observed_phase{f}_core_reads") for f in range(3)])
    x = rows.join(region, "candidate", "left").join(got, "candidate", "left")
    x = x.fillna(0, ["orf_region_reads", "core_reads", "n_active_core_codons", *[f"observed_phase{f}_core_reads" for f in range(3)]])
    x = candidates.coverage(x.withColumnRenamed("n_active_core_codons", "active"), s.least_core, s.least_active, s.least_reads).withColumnRenamed("active", "n_active_core_codons")
    fits, apart = None, {}
    eligible = kept(core.join(x.filter("prefilter_reason is null").select("candidate", F.col("overlap_type").alias("kind")), "candidate"))
    for kind in ("F1", "F2"):
        apart[kind] = dm.separated(candidates.host_template(kind, pi), pi, 2 if kind == "F1" else 1, s.separation)
        one = _fitted(eligible.filter(F.col("kind") == kind).filter("c0 + c1 + c2 > 0") if apart[kind] else eligible.limit(0), kind, pi, a0, s)
        fits = one if fits is None else fits.unionByName(one)
    fits = kept(fits)
    held = eligible.filter("c0 + c1 + c2 > 0").groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("codon", "c0", "c1", "c2"))).alias("codons"))
    three = lambda p: F.array(*[F.col(f"{p}_{f}") for f in range(3)])
    drawn = fits.join(held, "candidate").select(F.col("candidate").alias("key"), "codons", three("pi_host").alias("host"), three("pi_trans").alias("trans"), F.lit(a0).alias("a0"), "lambda_hat", F.col("lrt_stat").alias("lrt"), "p_asym", F.col("lag1_residual_autocorrelation").alias("lag1"))
    final = resample.final_p(kept(drawn), s.engine, s.mode, s.reps, s.importance_reps, gate=s.gate, blocks=s.blocks, seed=s.seed, sampler=SAMPLERS[s.sampler])
    final = final.withColumnsRenamed({"key": "candidate", "p_final": "p_tested", "classification_pre_fdr": "class_tested"}).drop("p_asym", "lag1")
    x = x.join(fits.drop("overlap_type"), "candidate", "left").join(final, "candidate", "left")
    same = F.element_at(F.create_map(*[F.lit(v) for k, ok in apart.items() for v in (k, ok)]), F.col("overlap_type"))
    pre = F.when(~same, "template_separation_too_small").when(F.col("peptide_len") < s.least_aa, "too_short").when(F.col("prefilter_reason").isNotNull(), "insufficient_data").otherwise(F.col("class_tested"))
    share = F.col("n_active_core_codons") / F.nullif("n_core_codons", F.lit(0))
    residual = F.col("target_vs_unused_z05_codons") / F.nullif("n_active_core_codons", F.lit(0).cast("long"))
    enough, wide = F.col("n_active_core_codons") >= s.credible_active, F.coalesce(share, F.lit(0.0)) >= s.credible_active_frac
    reads: list[Column] = [((1 - F.col("lambda_hat")) * F.col("core_reads")).alias("model_expected_host_cds_core_reads"), (F.col("lambda_hat") * F.col("core_reads")).alias("model_expected_intorf_core_reads")]
    x = x.withColumns(
        {
            "classification_pre_fdr": pre, "p_final": F.coalesce("p_tested", F.lit(1.0)), "template_separation_ok": F.coalesce(same, F.lit(False)).cast("int"), "active_core_codon_frac": F.coalesce(share, F.lit(0.0)), "analyzed_core_reads": F.col("core_reads"),
            "credible_active_core_breadth_ok": (enough & wide).cast("int"), "active_core_breadth_label": F.when(enough & wide, "pass").when(~enough & ~wide, "low_active_core_codons_and_fraction").when(~enough, "low_active_core_codons").otherwise("low_active_core_fraction"),
            "target_vs_unused_z05_frac_active": F.coalesce(residual, F.lit(0.0)), "credible_target_residual_breadth_ok": F.coalesce(residual > s.residual_frac, F.lit(False)).cast("int"), "prefilter_reason": F.coalesce("prefilter_reason", F.lit("")),
        }
    ).drop("p_tested", "class_tested")
    for c in ("importance_status",):
        x = x if c in x.columns else x.withColumn(c, F.lit("not_run"))
    x = x.select("*", *reads).drop("sizes", "starts1", "blocks_01", "blocks", "torf", "gorf", "same_gene", "any_gene", "confounded")
    return fdr.apply(x, s.primary_aa, s.fdr, s.lambda_min, s.farthest)

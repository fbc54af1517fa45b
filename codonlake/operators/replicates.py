"""Replicates: loading, integration with metadata and wide columns, and the tables of replicate reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.functions.sqlx import finite, pearson
from codonlake.operators.fdr import CREDIBLE

#: Columns that name a candidate, and those of the evidence for it.
IDENTITY = ("gorf_id", "overlap_type", "gene_id", "gene_name", "chrom", "strand", "orf_biotype", "aa_len", "peptide_len")
EVIDENCE = ("classification", "primary_credible_call", "q_BH", "q_BY", "p_final", "lambda_hat", "core_reads", "n_active_core_codons", "active_core_codon_frac", "mixture_geometry_consistent", "distance_to_mixture_segment")
REQUIRED = ("gorf_id", "overlap_type", "classification", "q_BH", "lambda_hat", "core_reads")
WIDE = ("present", "classification", "primary_credible_call", "q_BH", "lambda_hat", "core_reads")
LABELS = ("reproducible_primary_credible", "single_replicate_primary_credible", "primary_credible_not_reproducible", "not_primary_credible")


def number(c: Column) -> Column:
    """A whole number from text, truncated; 0 for what is none."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def load(results: DataFrame, replicate: str | Column) -> DataFrame:
    """The rows of one replicate, or of all that a column names, as text with candidate_key and replicate_id; a missing column is an
    error, and a blank key, or one that comes twice in a replicate, stops the job."""
    if missing := sorted(set(REQUIRED) - set(results.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    x = results
    if "primary_credible_call" not in x.columns:
        x = x.withColumn("primary_credible_call", (F.col("classification") == CREDIBLE).cast("int"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in x.columns else F.lit("")
    keys = {c: F.trim(text(c)) for c in ("gorf_id", "overlap_type")}
    x = x.select(*[keys.get(c, text(c)).alias(c) for c in (*IDENTITY, *EVIDENCE)], (F.lit(replicate) if isinstance(replicate, str) else replicate).alias("replicate_id"))
    seen = F.count(F.lit(1)).over(W.partitionBy("gorf_id", "overlap_type", "replicate_id"))
    wrong = F.when((F.col("gorf_id") == "") | (F.col("overlap_type") == ""), "a candidate without its names").when(seen > 1, F.concat(F.lit("a candidate comes twice: "), "gorf_id", F.lit("/"), "overlap_type"))
    key = F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).cast("string")).otherwise(F.concat("gorf_id", F.lit("|"), "overlap_type"))
    return x.withColumn("_wrong", wrong).select(key.alias("candidate_key"), "replicate_id", *IDENTITY, *EVIDENCE)


def label(primary: Column, available: int, least: int, least_share: float) -> Column:
    """What the number of replicates that call a candidate amounts to; the share is of those available."""
    if available < least:
        return F.when(primary > 0, LABELS[1]).otherwise(LABELS[3])
    return F.when((primary >= least) & (primary / available >= least_share), LABELS[0]).when(primary > 0, LABELS[2]).otherwise(LABELS[3])


def integrate(rows: DataFrame, expected: Sequence[str], available: Sequence[str], least: int = 2, least_share: float = 0.5, fdr: float = 0.05) -> DataFrame:
    """One row for each candidate of any replicate, in one aggregation: metadata of its first replicate, columns whose values conflict,
    support, and six columns for each expected replicate. rows: `load`'s, of all available replicates."""
    if not expected or len(set(expected)) < len(expected):
        raise ValueError("expected replicates must be given once each")
    if not available or set(available) - set(expected):
        raise ValueError("available replicates must be among the expected ones")
    place = F.element_at(F.create_map(*[F.lit(v) for k, r in enumerate(expected) for v in (r, k)]), F.col("replicate_id"))
    value = lambda c: finite(F.trim(F.col(c)))
    called = number(F.col("primary_credible_call")) == 1
    cell = lambda r, c: F.max(F.when(F.col("replicate_id") == r, F.col(c)))
    x = rows.withColumn("_at", place)
    x = x.groupBy("candidate_key").agg(
        F.min_by(F.struct(*IDENTITY), "_at").alias("first"), *[(F.min(c) != F.max(c)).alias(f"_n_{c}") for c in IDENTITY], F.count(F.lit(1)).alias("n_replicates_observed"), F.count_if(called).alias("n_primary_credible"),
        F.count_if(value("q_BH") <= fdr).alias("n_bh_significant"), F.min(value("q_BH")).alias("min_q_BH"), F.median(value("q_BH")).alias("median_q_BH"), F.median(value("lambda_hat")).alias("median_lambda_hat"), F.max(number(F.col("core_reads"))).alias("max_core_reads"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(called, F.struct("_at", "replicate_id")))), lambda s: s["replicate_id"]), ",").alias("primary_credible_replicates"),
        *[(F.count_if(F.col("replicate_id") == r) if c == "present" else F.coalesce(cell(r, c), F.lit(""))).alias(f"replicate::{r}::{c}") for r in expected for c in WIDE],
    )
    conflicts = F.concat_ws(",", *[F.when(F.col(f"_n_{c}"), c) for c in IDENTITY])
    n = F.col("n_primary_credible")
    return x.select(
        "candidate_key", "first.*", conflicts.alias("metadata_conflict_columns"), F.lit(len(expected)).alias("n_replicates_expected"), F.lit(len(available)).alias("n_replicates_available"), "n_replicates_observed", "n_primary_credible",
        (n / len(available)).alias("primary_credible_fraction_available"), "n_bh_significant", "min_q_BH", "median_q_BH", "median_lambda_hat", "max_core_reads", label(n, len(available), least, least_share).alias("consensus_classification"),
        "primary_credible_replicates", *[F.col(f"`replicate::{r}::{c}`") for r in expected for c in WIDE],
    )


def label_counts(consensus: DataFrame) -> DataFrame:
    """metric, value: candidates by label, labels without one included."""
    one = consensus.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("consensus_classification") == x).alias(x) for x in LABELS])
    return one.select(F.inline(F.array(F.struct(F.lit("candidate_union_total").alias("metric"), F.col("n").alias("value")), *[F.struct(F.lit(f"consensus::{x}").alias("metric"), F.col(x).alias("value")) for x in LABELS])))


#: What runs that are integrated must agree on.
AGREE = ("program", "version", "output_schema_version", "statistical_engine_id", "benchmark_certification_id")
PARAMETERS = tuple(
    """pi_method min_a0 rl rl_source template_min_cds_nt template_min_density template_trim_start_nt template_trim_stop_nt template_min_codon_reads trim_fraction trim_reservoir_size min_intorf_aa
    primary_min_intorf_aa min_core_codons min_active_core_codons min_core_reads min_credible_active_core_codons min_credible_active_core_frac min_credible_target_residual_frac exclude_start_codons
    exclude_stop_codons include_annotated_stop_confounded bootstrap_gate_p bootstrap_reps bootstrap_engine importance_mode importance_reps importance_iid_exceedance_threshold importance_etas
    importance_pilot_reps importance_confirm_min_reps importance_allocation_safety_factor importance_use_for_p_final importance_min_tail_ess importance_max_relative_se seed disable_block_bootstrap
    fdr_threshold lambda_min template_separation_min lambda_grid_size lambda_abs_diff_max lambda_rel_diff_max lambda_rel_eps distance_to_segment_max lag1_threshold min_active_for_lag1 block_sizes
    review_gate_window candidate_dedup require_gorf_id candidate_mane_only no_preload_psites no_coverage_prefilter member_preview_n""".split()
)


def parse_manifest(text: str, name: str) -> dict:
    """A run's manifest: one JSON object."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"the manifest of {name} can't be read") from error
    if not isinstance(found, dict):
        raise ValueError(f"the manifest of {name} is no object")
    return found


def signature(manifest: Mapping) -> dict:
    """What runs must agree on: versions, the caller's hash, parameters, identities of the tORF files, the schema. What is missing is an error."""
    parameters, inputs = manifest.get("parameters"), manifest.get("inputs")
    caller = (manifest.get("source") or {}).get("caller") or {}
    files = inputs.get("torf_files") if isinstance(inputs, dict) else None
    if not isinstance(parameters, dict) or not caller.get("sha256") or not files or not manifest.get("output_schema"):
        raise ValueError("the manifest lacks parameters, the caller's hash, tORF files or the schema")
    lost = [k for k in AGREE if k not in manifest] + [k for k in PARAMETERS if k not in parameters]
    if lost:
        raise ValueError(f"the manifest lacks: {', '.join(lost)}")
    if not all(isinstance(f, dict) and f.get("exists") for f in files):
        raise ValueError("a tORF file of the manifest wasn't there")
    known = [("sha256", f["sha256"], f.get("size_bytes")) if f.get("sha256") else ("path_stat", f.get("path"), f.get("size_bytes"), f.get("mtime_utc")) for f in files]
    return {**{k: manifest[k] for k in AGREE}, "caller_sha256": caller["sha256"], "parameters": {k: parameters[k] for k in PARAMETERS}, "torf_inputs": sorted(known, key=lambda x: tuple(map(str, x))), "output_schema": list(manifest["output_schema"])}


def compatible(manifests: Mapping[str, Mapping]) -> dict:
    """The signature that all runs share; a run that differs is an error that names the fields."""
    found = {}
    for name, m in manifests.items():
        try:
            found[name] = signature(m)
        except ValueError as error:
            raise ValueError(f"{name}: {error}") from error
    if not found:
        raise ValueError("there are no manifests")
    first = next(iter(found))
    for name, s in found.items():
        if differing := [k for k in s if s[k] != found[first][k]]:
            raise ValueError(f"{name} doesn't fit {first}: {', '.join(differing)}")
    return found[first]


def fits_manifest(results: DataFrame, manifest: Mapping, size: int | None = None, sha256: str | None = None) -> None:
    """Raises where a result has other columns, rows, bytes or another hash than its manifest says."""
    if list(manifest.get("output_schema") or []) != results.columns:
        raise ValueError("the result has other columns than its manifest says")
    if number_of(manifest.get("result_rows")) != results.count():
        raise ValueError("the result has another number of rows than its manifest says")
    outputs = [o for o in manifest.get("outputs") or [] if isinstance(o, dict) and str(o.get("path", "")).endswith(".intorf_dm_results.tsv")]
    if len(outputs) != 1:
        raise ValueError("the manifest must name one result")
    if size is not None and outputs[0].get("size_bytes") != size:
        raise ValueError("the result has another size than its manifest says")
    if sha256 is not None and outputs[0].get("sha256") and outputs[0]["sha256"] != sha256:
        raise ValueError("the result has another hash than its manifest says")


def number_of(x: object) -> int:
    try:
        return int(float(str(x).strip()))
    except ValueError:
        return 0


def load_abundance(rows: DataFrame, replicate: str) -> DataFrame:
    """candidate_key, replicate_id, status, x: a replicate's quantities, x null unless quantified; blank or repeated keys, negative values and quantified ones without a number stop the job."""
    if missing := sorted({"gorf_id", "overlap_type", "abundance_status", "intorf_pFPKM"} - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    g, o = F.trim(F.coalesce("gorf_id", F.lit(""))), F.trim(F.coalesce("overlap_type", F.lit("")))
    value, status = finite(F.trim(F.col("intorf_pFPKM").cast("string"))), F.trim(F.coalesce("abundance_status", F.lit("")))
    seen = F.count(F.lit(1)).over(W.partitionBy("_key"))
    x = rows.select(F.concat(g, F.lit("|"), o).alias("_key"), ((g == "") | (o == "")).alias("_blank"), value.alias("_x"), status.alias("status"))
    wrong = F.when(F.col("_blank"), "a candidate without its names").when(seen > 1, "a candidate comes twice").when(F.col("_x") < 0, "a negative quantity").when((F.col("status") == "quantified") & F.col("_x").isNull(), "a quantity is no number")
    x = x.withColumn("_wrong", wrong)
    key = F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).cast("string")).otherwise(F.col("_key"))
    return x.select(key.alias("candidate_key"), F.lit(replicate).alias("replicate_id"), "status", F.when(F.col("status") == "quantified", F.col("_x")).alias("x"))


def metadata(rows: DataFrame) -> DataFrame:
    """replicate_id, psite_alignments, frame0_prop, A0 from either set of names; a blank or repeated replicate stops the job."""
    names = {"frame0_prop": "qc_frame0_prop", "A0": "qc_A0"}
    if {"replicate_id", "psite_alignments"} - set(rows.columns) or any(a not in rows.columns and b not in rows.columns for a, b in names.items()):
        raise ValueError("the metadata lack columns")
    pick = lambda c: F.coalesce(*[F.col(x) for x in (c, names[c]) if x in rows.columns]).alias(c)
    name = F.trim("replicate_id")
    wrong = F.when(name == "", "a replicate without name").when(F.count(F.lit(1)).over(W.partitionBy(name)) > 1, "a replicate comes twice")
    lengths = F.col("selected_length_offsets") if "selected_length_offsets" in rows.columns else F.lit("")
    x = rows.select(name.alias("_name"), wrong.alias("_wrong"), "psite_alignments", pick("frame0_prop"), pick("A0"), lengths.alias("selected_length_offsets"))
    return x.select(F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).cast("string")).otherwise(F.col("_name")).alias("replicate_id"), "psite_alignments", "frame0_prop", "A0", "selected_length_offsets")


def compact(n: Column) -> Column:
    """A count as short text."""
    v = finite(n)
    return F.when(v.isNull(), "NA").when(v >= 1e6, F.concat(F.format_string("%.1f", F.bround(v / 1e6, 1)), F.lit("M"))).when(v >= 1e3, F.concat(F.format_string("%.1f", F.bround(v / 1e3, 1)), F.lit("k"))).otherwise(F.format_string("%.0f", F.bround(v, 0)))


def quality_labels(replicates: DataFrame, meta: DataFrame) -> DataFrame:
    """replicate_id, label: the name with depth, read lengths, share of phase 0 and concentration; the bare name without metadata."""
    f0, a0 = finite(F.col("frame0_prop")), finite(F.col("A0"))
    parts = F.filter(F.split(F.coalesce("selected_length_offsets", F.lit("")), ","), lambda x: F.trim(x) != "")
    lengths = F.array_join(F.transform(parts, lambda x: F.trim(F.substring_index(x, ":", 1))), "/")
    depth = F.concat(compact(F.col("psite_alignments")), F.lit(" P-sites"), F.when(lengths != "", F.concat(F.lit(" · L "), lengths)).otherwise(""))
    share = F.coalesce(F.concat(F.format_string("%.1f", F.bround(f0 * 100, 1)), F.lit("%")), F.lit("NA"))
    share = F.when(f0.isNull(), "NA").otherwise(share)
    conc = F.when(a0.isNull(), "NA").otherwise(F.format_string("%.2f", F.bround(a0, 2)))
    text = F.concat(F.col("replicate_id"), F.lit("\n"), depth, F.lit("\nF0 "), share, F.lit(" · A0 "), conc)
    x = replicates.select("replicate_id").join(F.broadcast(meta.withColumn("_known", F.lit(True))), "replicate_id", "left")
    return x.select("replicate_id", F.when(F.col("_known"), text).otherwise(F.col("replicate_id")).alias("label"))


def call_counts(rows: DataFrame, replicates: Sequence[str], fdr: float = 0.05) -> DataFrame:
    """replicate_id, total, significant, primary_calls; a replicate without rows has zeros."""
    q, own = finite(F.trim(F.col("q_BH").cast("string"))), F.col("replicate_id")
    one = rows.agg(*[x for k, r in enumerate(replicates) for x in (F.count_if(own == r).alias(f"t{k}"), F.count_if((own == r) & (q <= fdr)).alias(f"s{k}"), F.count_if((own == r) & (number(F.col("primary_credible_call")) == 1)).alias(f"p{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("replicate_id"), F.col(f"t{k}").alias("total"), F.col(f"s{k}").alias("significant"), F.col(f"p{k}").alias("primary_calls")) for k, r in enumerate(replicates)])))


def state_matrix(consensus: DataFrame, replicates: Sequence[str], most: int = 100, by_pattern: bool = False) -> DataFrame:
    """rank, candidate_key, label, and a state for each replicate (-1 without any row, 0 absent, 1 seen, 2 primary) of the first
    candidates that any replicate calls: most support first, then (on request) the states, then depth and key."""
    seen = consensus.agg(*[F.coalesce(F.max(number(F.col(f"`replicate::{r}::present`"))), F.lit(0)).alias(f"any{k}") for k, r in enumerate(replicates)])
    x = consensus.filter(number(F.col("n_primary_credible")) > 0).join(F.broadcast(seen))  # one row
    state = lambda k, r: F.when(F.col(f"any{k}") != 1, -1).when(number(F.col(f"`replicate::{r}::present`")) != 1, 0).when(number(F.col(f"`replicate::{r}::primary_credible_call`")) == 1, 2).otherwise(1)
    x = x.select("*", *[state(k, r).alias(f"state{k}") for k, r in enumerate(replicates)])
    order = [F.desc(number(F.col("n_primary_credible"))), *([F.desc(f"state{k}") for k in range(len(replicates))] if by_pattern else []), F.desc(number(F.col("max_core_reads"))), F.asc("candidate_key")]
    top = display_labels(x.orderBy(*order).limit(most))
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "candidate_key", "label", *[f"state{k}" for k in range(len(replicates))])


def display_labels(rows: DataFrame) -> DataFrame:
    """Adds `label`: the gene; where several rows have the same, with overlap type and the last six characters of the genomic ORF's hash."""
    word = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    base = F.coalesce(word("gene_name"), word("gene_id"), word("candidate_key"), F.lit("unknown candidate"))
    token = F.get(F.filter(F.split(F.coalesce("gorf_id", F.lit("")), r"\|"), lambda p: p.startswith("h") & (F.length(p) > 1)), F.lit(0))
    details = F.concat_ws("; ", word("overlap_type"), F.concat(F.lit("h..."), F.right(token, F.lit(6))))
    several = F.count(F.lit(1)).over(W.partitionBy("_base")) > 1
    x = rows.withColumn("_base", base).withColumn("_details", details)
    named = F.when(F.col("_details") != "", F.concat("_base", F.lit(" ("), "_details", F.lit(")"))).otherwise(F.coalesce(word("candidate_key"), F.col("_base")))
    return x.withColumn("label", F.when(several, named).otherwise(F.col("_base"))).drop("_base", "_details")


def abundance_matrix(consensus: DataFrame, abundance: DataFrame, replicates: Sequence[str]) -> DataFrame:
    """candidate_key, support, middle, r0, r1, ...: quantities of the candidates that any replicate calls, blank unless quantified; rows
    without any quantity go. `place` orders them: most support, largest median, key."""
    called = consensus.filter(number(F.col("n_primary_credible")) > 0).select("candidate_key", number(F.col("n_primary_credible")).alias("support"))
    value = F.when((F.col("status") == "quantified") & (F.col("x") >= 0), F.col("x"))
    wide = abundance.withColumn("v", value).groupBy("candidate_key").agg(F.median("v").alias("middle"), *[F.max(F.when(F.col("replicate_id") == r, F.col("v"))).alias(f"r{k}") for k, r in enumerate(replicates)])
    return called.join(wide.filter("middle is not null"), "candidate_key")


def matrix_order() -> list[Column]:
    return [F.desc("support"), F.desc("middle"), F.asc("candidate_key")]


def matrix_correlations(matrix: DataFrame, replicates: Sequence[str]) -> DataFrame:
    """rep_a, rep_b, n, pearson, spearman of log2(1 + x) over the rows that both have, for every pair of replicates.

    Ranks are taken over distinct values with their counts, a pair of columns at a time in one table, so no task ranks
    all rows of a pair: running totals give them."""
    from codonlake.functions import skew

    pairs = [(i, j) for i in range(len(replicates)) for j in range(i + 1, len(replicates))]
    sides = F.array(*[F.struct(F.lit(f"{i}-{j}").alias("pair"), F.log2(1 + F.col(f"r{i}")).alias("a"), F.log2(1 + F.col(f"r{j}")).alias("b")) for i, j in pairs])
    rows = matrix.select(F.inline(sides)).filter("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("k"))
    out = rows
    for s in "ab":
        values = rows.groupBy("pair", s).agg(F.sum("k").alias("k"))
        ranked = skew.running(skew.ranges(values, "pair", s), "pair", s, F.col("k"), "upto")
        out = out.join(ranked.select("pair", s, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"rank_{s}")), ["pair", s])
    long = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "k")))
    enough = lambda x, y: F.when(F.count(F.lit(1)) > 1, pearson(x, y))
    found = long.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), enough(F.col("a"), F.col("b")).alias("pearson"), enough(F.col("rank_a"), F.col("rank_b")).alias("spearman"))
    named = matrix.sparkSession.createDataFrame([(f"{i}-{j}", replicates[i], replicates[j]) for i, j in pairs], "pair string, rep_a string, rep_b string")
    return F.broadcast(named).join(found, "pair", "left").select("rep_a", "rep_b", F.coalesce("n", F.lit(0)).alias("n"), "pearson", "spearman")


def pure_only(consensus: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consensus and rows of the candidates that are pure at the level of genes, and one row of how many others there are."""
    pure = number(F.col("gene_level_pure_intorf_eligible")) == 1
    kept = consensus.filter(pure)
    return kept, rows.join(kept.select("candidate_key"), "candidate_key", "left_semi"), consensus.agg(F.count_if(~pure).alias("gene_context_excluded"))


def unexpected(abundance: DataFrame, consensus: DataFrame) -> DataFrame:
    """candidate_key of quantities whose candidate the consensus doesn't have; none in tables that belong together."""
    return abundance.select("candidate_key").distinct().join(consensus, "candidate_key", "left_anti")

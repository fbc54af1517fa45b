"""Candidates: filters with their reasons, grouping, coverage, and the quality contract of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Members of a group that are named.
PREVIEW = 20


def overlap_type(t_start: Column, cds_first: Column) -> Column:
    """F1 or F2 by the frame against the CDS; null in its frame."""
    frame = F.pmod(t_start - cds_first, F.lit(3))
    return F.when(frame == 1, "F1").when(frame == 2, "F2")


def host_template(kind: str, pi: tuple[float, float, float]) -> tuple[float, float, float]:
    """The CDS template as a candidate of this overlap type sees it."""
    shift = {"F1": 1, "F2": 2}[kind]
    return (*pi[shift:], *pi[:shift])


def rejection(least_peptide: int = 6, least_core: int = 3, mane_only: bool = False) -> Column:
    """The first filter that a row(overlap_type, peptide_len, n_core_codons, mane) fails; null if it passes all."""
    out = F.when(F.col("overlap_type").isNull(), "invalid_overlap_type").when(F.col("peptide_len") < least_peptide, "peptide_too_short").when(F.col("n_core_codons") < least_core, "core_too_short")
    return out.when(F.col("mane") != 1, "not_mane") if mane_only else out


def eligible(rows: DataFrame) -> DataFrame:
    """rows(orf_biotype, is_annotated_cds, mane, sizes, starts1, same_gene, any_gene, confounded) that are MANE CDSs (`template`) or
    alternative-frame ORFs, with blocks that fit each other. Flags of annotated stops must be 0 or 1, a stop of the gene
    must be one of any gene, and confounded says the same as any gene: anything else stops the job."""
    binary = lambda c: F.coalesce(F.col(c).cast("string").isin("0", "1"), F.lit(False))
    flags = ("same_gene", "any_gene", "confounded")
    wrong = F.when(~(binary(flags[0]) & binary(flags[1]) & binary(flags[2])), "a flag of annotated stops is neither 0 nor 1").when((F.col("same_gene") == 1) & (F.col("any_gene") != 1), "a stop of the gene is none of any gene").when(F.col("confounded") != F.col("any_gene"), "confounded differs from the stop of any gene")
    kind = F.when((F.col("orf_biotype") == "CDS") & (F.col("is_annotated_cds") == 1) & (F.col("mane") == 1), "template").when(F.col("orf_biotype") == "intORF_altframe", "candidate")
    sound = F.coalesce((F.size("sizes") > 0) & (F.size("sizes") == F.size("starts1")) & ~F.exists("sizes", lambda n: n <= 0), F.lit(False))
    x = rows.withColumn("use", kind).filter(F.col("use").isNotNull() & sound)
    sure = F.when((F.col("use") == "candidate") & wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("use"))
    return x.withColumn("use", sure)


#: What a result tells of its candidate before anything is fitted.
BASE = (
    "torf_id", "gene_id", "gene_name", "transcript_id", "chrom", "strand", "t_start", "t_end", "aa_len", "peptide_len", "orf_biotype", "intorf_shares_annotated_stop_same_gene", "intorf_shares_annotated_stop_any_gene",
    "intorf_annotated_stop_confounded", "gorf_id", "n_member_torfs", "n_member_transcripts", "member_torf_ids_preview", "member_transcripts_preview",
)


def base_result(rows: DataFrame) -> DataFrame:
    """The columns of `BASE` and candidate_order; columns that rows lack are null."""
    names = set(rows.columns)
    return rows.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in BASE], F.col("candidate_order") if "candidate_order" in names else F.lit(None).cast("long").alias("candidate_order"))


def grouped(rows: DataFrame, by: str = "gorf", keep_confounded: bool = False, ordered: bool = False) -> DataFrame:
    """One row for each candidate: rows(torf, gorf, blocks, overlap_type, mane, peptide_len, confounded).

    by: gorf (blocks where it is blank), blocks or none. The representative is a MANE member if there is one, then the longest
    peptide, then the greatest name. One confounded member drops its group unless asked otherwise.
    ordered: rows have a line; a candidate has the first of its members'."""
    keys = {"gorf": F.coalesce(F.nullif("gorf", F.lit("")), F.col("blocks")), "blocks": F.col("blocks"), "none": F.col("torf")}
    if by not in keys:
        raise ValueError(f"unknown grouping: {by}")
    best = F.max(F.struct("mane", "peptide_len", "torf"))
    named = rows.withColumn("candidate", F.concat_ws("|", keys[by], "overlap_type"))
    # names for reading, the first twenty in order: a group's other names are dropped before they are gathered
    few = named.select("candidate", "torf").distinct().withColumn("k", F.row_number().over(W.partitionBy("candidate").orderBy("torf"))).filter(F.col("k") <= PREVIEW)
    few = few.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_list("torf")), ",").alias("members"))
    x = named.groupBy("candidate", "overlap_type").agg(best.alias("best"), F.count(F.lit(1)).alias("n_members"), F.max("confounded").alias("confounded"), *([F.min("line").alias("line")] if ordered else [])).join(few, "candidate")
    x = x if keep_confounded else x.filter("confounded = 0")
    return x.select("candidate", "overlap_type", F.col("best.torf").alias("representative"), F.col("best.mane").alias("mane"), F.col("best.peptide_len").alias("peptide_len"), "n_members", "confounded", "members", *(["line"] if ordered else []))


def coverage(rows: DataFrame, least_core: int = 3, least_active: int = 3, least_reads: int = 15) -> DataFrame:
    """rows(n_core_codons, active, core_reads): adds the reason for too little data; such rows stay, with p 1."""
    reason = F.when(F.col("n_core_codons") < least_core, "core_codons").when(F.col("active") < least_active, "active_codons").when(F.col("core_reads") < least_reads, "core_reads")
    x = rows.withColumn("prefilter_reason", reason)
    failed = F.col("prefilter_reason").isNotNull()
    return x.withColumn("classification_pre_fdr", F.when(failed, "insufficient_data").otherwise("eligible")).withColumn("p_final", F.when(failed, 1.0))


def contract(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds qc_status, and the names of failed checks joined by `;`. A result without significance fails no check."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))
    return rows.withColumn("qc_flags", F.array_join(failed, ";")).withColumn("qc_status", F.when(F.size(failed) == 0, "pass").otherwise("fail"))


def summary(rows: DataFrame) -> DataFrame:
    """metric, value: counts by class and by testing family, in one pass."""
    parts = F.array(F.concat(F.lit("class:"), "classification"), F.concat(F.lit("family:"), "family"), F.lit("candidates"))
    return rows.select(F.explode(parts).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))

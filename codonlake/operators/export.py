"""Export of codons: which ORFs, their codons with genomic positions, exact ratios, summaries, and the check against saved totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.operators.reports import gcd

#: What every exported row tells of its ORF, and the totals that saved results must repeat.
IDENTITY = ("sample", "candidate_key", "gorf_id", "torf_id", "gene_id", "gene_name", "transcript_id", "overlap_type", "classification", "q_BH", "lambda_hat")
TOTALS = ("core_reads", "analyzed_core_reads", "n_active_core_codons", "n_core_codons", "observed_phase0_core_reads", "observed_phase1_core_reads", "observed_phase2_core_reads")


def candidate_key() -> Column:
    """gorf|overlap; the tORF where there is no genomic ORF."""
    gorf = F.trim(F.coalesce(F.col("gorf_id"), F.lit("")))
    return F.when(gorf != "", F.concat(gorf, F.lit("|"), F.trim(F.coalesce(F.col("overlap_type"), F.lit(""))))).otherwise(F.trim(F.coalesce(F.col("torf_id"), F.lit(""))))


def identifiers() -> Column:
    """The names that a row answers to."""
    return F.array_distinct(F.filter(F.array(candidate_key(), F.trim("gorf_id"), F.trim("torf_id")), lambda x: x.isNotNull() & (x != "")))


def selected(results: DataFrame, wanted: DataFrame | None = None, selection: str = "credible", pure_only: bool = False) -> DataFrame:
    """The rows to export, with candidate_key. wanted(id): these ORFs and no other filter; else credible ones or all.

    An id that no row has, a selection without rows, and two rows of one key are errors."""
    if selection not in ("credible", "all"):
        raise ValueError(f"unknown selection: {selection}")
    x = results.withColumn("candidate_key", candidate_key())
    if wanted is not None:
        ids = wanted.select("id").distinct()
        named = x.withColumn("_id", F.explode(identifiers()))
        lost = ids.join(named.select(F.col("_id").alias("id")), "id", "left_anti")
        if missing := [r.id for r in lost.orderBy("id").limit(10).collect()]:
            raise ValueError(f"no rows for the ids: {', '.join(missing)}")
        x = named.join(ids.withColumnRenamed("id", "_id"), "_id", "left_semi").drop("_id").dropDuplicates()
    else:
        yes = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin("1", "true", "yes", "y")
        x = x.filter(yes("primary_credible_call")) if selection == "credible" else x
        x = x.filter(yes("gene_level_pure_intorf_eligible")) if pure_only else x
    twice = x.groupBy("candidate_key").count().filter("count > 1").orderBy("candidate_key").limit(1).collect()
    if twice:
        raise ValueError(f"two rows of one key: {twice[0].candidate_key}")
    if x.isEmpty():
        raise ValueError("no rows are selected")
    return x


def genomic_position(blocks: Column, strand: Column, t: Column) -> Column:
    """0-based genomic position of an ORF index; null outside. blocks: array of (start0, end0) in any order."""
    ordered = F.when(strand == "-", F.reverse(F.array_sort(blocks))).otherwise(F.array_sort(blocks))
    start = F.struct(t.cast("long").alias("left"), F.lit(None).cast("long").alias("hit"))

    def step(s: Column, b: Column) -> Column:
        n = b["end0"] - b["start0"]
        inside = s["hit"].isNull() & (s["left"] >= 0) & (s["left"] < n)
        return F.struct((s["left"] - n).alias("left"), F.when(inside, F.when(strand == "-", b["end0"] - 1 - s["left"]).otherwise(b["start0"] + s["left"])).otherwise(s["hit"]).alias("hit"))

    return F.aggregate(ordered, start, step, lambda s: s["hit"])


def core(codons: DataFrame, first: int = 1, last: int = 1) -> DataFrame:
    """codons(key, codon, n_codons, c0, c1, c2) without the first and last codons, with the place in the core."""
    lo, hi = F.least(F.lit(first), F.col("n_codons")), F.greatest(F.least(F.lit(first), F.col("n_codons")), F.col("n_codons") - last)
    return codons.withColumn("core_codon_index0", F.col("codon") - lo).filter((F.col("codon") >= lo) & (F.col("codon") < hi)).withColumn("n_core", hi - lo)


def codon_rows(core_codons: DataFrame, orfs: DataFrame, key: str = "candidate_key", least_reads: int = 1) -> DataFrame:
    """A row for each core codon with enough reads: 1-based positions of its phases, reads, fractions and percents.

    orfs: key, chrom, strand, blocks."""
    depth = F.col("c0") + F.col("c1") + F.col("c2")
    x = core_codons.filter(depth >= max(1, least_reads)).join(orfs.select(key, "chrom", "strand", "blocks"), key)
    place = lambda f: (genomic_position(F.col("blocks"), F.col("strand"), F.col("codon") * 3 + f) + 1).alias(f"phase{f}_genomic_pos1")
    return x.select(
        key, "chrom", "strand", F.col("codon").alias("orf_codon_index0"), "core_codon_index0", *[place(f) for f in range(3)], *[F.col(f"c{f}").alias(f"phase{f}_reads") for f in range(3)], depth.alias("codon_reads"),
        *[(F.col(f"c{f}") / depth).alias(f"phase{f}_fraction") for f in range(3)], *[(F.lit(100.0) * F.col(f"c{f}") / depth).alias(f"phase{f}_percent") for f in range(3)],
    )


def ternary_rows(core_codons: DataFrame, key: str = "candidate_key", least_reads: int = 1) -> DataFrame:
    """A row for each exact ratio of a key's codons, in lowest terms, with its share of them."""
    depth = F.col("c0") + F.col("c1") + F.col("c2")
    g = gcd(gcd(F.col("c0"), F.col("c1")), F.col("c2"))
    x = core_codons.filter(depth >= max(1, least_reads)).withColumn("g", g).select(key, *[F.expr(f"c{f} div g").alias(f"phase_ratio_P{f}") for f in range(3)])
    ratio = [f"phase_ratio_P{f}" for f in range(3)]
    n = x.groupBy(key, *ratio).agg(F.count(F.lit(1)).alias("codon_count"))
    total = n.groupBy(key).agg(F.sum("codon_count").alias("total_plotted_codons"))
    whole = sum((F.col(c) for c in ratio[1:]), F.col(ratio[0]))
    shares = [(F.col(c) / whole).alias(f"exact_P{f}_fraction") for f, c in enumerate(ratio)] + [(F.lit(100.0) * F.col(c) / whole).alias(f"exact_P{f}_percent") for f, c in enumerate(ratio)]
    return n.join(total, key).select(key, *ratio, *shares, "codon_count", "total_plotted_codons", (F.lit(100.0) * F.col("codon_count") / F.col("total_plotted_codons")).alias("candidate_percentage"))


def summaries(core_codons: DataFrame, key: str = "candidate_key", least_reads: int = 1) -> DataFrame:
    """A row for each key: core codons and reads, codon-equal means and vertices in percent."""
    depth = F.col("c0") + F.col("c1") + F.col("c2")
    plotted = depth >= max(1, least_reads)
    share = lambda x: F.coalesce(F.lit(100.0) * x, F.lit(0.0))
    return core_codons.groupBy(key).agg(
        F.max("n_core").alias("n_core_codons"), F.count_if(depth > 0).alias("n_active_core_codons"), F.count_if(plotted).alias("n_plotted_codons"), F.sum(depth).alias("core_reads"), F.sum(F.when(plotted, depth).otherwise(0)).alias("plotted_codon_reads"),
        *[share(F.avg(F.when(plotted, F.col(f"c{f}") / depth))).alias(f"codon_equal_mean_P{f}_percent") for f in range(3)],
        *[share(F.avg(F.when(plotted, (F.col(f"c{f}") == depth).cast("double")))).alias(f"P{f}_vertex_percent") for f in range(3)],
    )


def totals(core_codons: DataFrame, key: str = "candidate_key") -> DataFrame:
    """The totals that a saved result must repeat."""
    n = F.col("c0") + F.col("c1") + F.col("c2")
    one = core_codons.groupBy(key).agg(F.sum(n).alias("core_reads"), F.sum(n).alias("analyzed_core_reads"), F.count_if(n > 0).alias("n_active_core_codons"), F.max("n_core").alias("n_core_codons"), *[F.sum(f"c{f}").alias(f"observed_phase{f}_core_reads") for f in range(3)])
    return one


def reconciled(saved: DataFrame, core_codons: DataFrame, key: str = "candidate_key") -> DataFrame:
    """key, mismatches (text, empty where all agree), status: saved totals against those of the codons. A saved value that is
    no whole number isn't compared; a key without codons has totals of 0."""
    again = totals(core_codons, key).select(key, *[F.col(c).alias(f"_{c}") for c in TOTALS])
    x = saved.join(again, key, "left")
    value = lambda c: F.when(F.col(c).try_cast("double") == F.floor(F.col(c).try_cast("double")), F.col(c).try_cast("double").cast("long"))
    zero = F.lit(0).cast("long")
    parts = [F.when(value(c) != F.coalesce(f"_{c}", zero), F.concat(F.lit(f"{c}: result="), value(c).cast("string"), F.lit(", recomputed="), F.coalesce(f"_{c}", zero).cast("string"))) for c in TOTALS if c in saved.columns]
    out = x.select(key, F.array_join(F.array_compact(F.array(*parts)), "; ").alias("mismatches"))
    return out.withColumn("status", F.when(F.col("mismatches") == "", "exact_match").otherwise("mismatch"))


def checked(report: DataFrame) -> None:
    """Raises where a saved total differs."""
    if bad := report.filter("status <> 'exact_match'").limit(1).collect():
        raise ValueError(f"saved totals differ: {bad[0][0]}: {bad[0].mismatches}")

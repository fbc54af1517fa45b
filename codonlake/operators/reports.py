"""Abundance, gene context, codon export, replicate integration and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions.sqlx import finite, pearson


def abundance(reads: Column, nt: Column, library: Column) -> Column:
    """Reads per kilobase and million."""
    return F.lit(1e9) * reads / (nt * library)


def quantify(rows: DataFrame, library: int) -> DataFrame:
    """rows(id, n_core_codons, reads, lambda, ci_low, ci_high, host_reads): status, pfpkm, its interval and the ratio to the host."""
    if library <= 0:
        raise ValueError("the library size must be positive")
    nt, size = F.col("n_core_codons") * 3, F.lit(float(library))
    bad = F.col("lambda").isNull() | F.isnan("lambda")
    status = F.when(F.coalesce(F.col("n_core_codons"), F.lit(0)) <= 0, "invalid_core_length").when(bad, "not_model_quantifiable").when((F.col("lambda") < 0) | (F.col("lambda") > 1), "invalid_model_expected_reads").otherwise("quantified")
    x = rows.withColumn("status", status)
    ok = F.col("status") == "quantified"
    part = lambda share: abundance(share * F.col("reads"), nt, size)
    interval = ok & (F.col("ci_low") >= 0) & (F.col("ci_low") <= F.col("ci_high")) & (F.col("ci_high") <= 1)
    return x.select(
        "id", "status", F.when(ok, part(F.col("lambda"))).alias("pfpkm"), F.when(interval, part(F.col("ci_low"))).alias("pfpkm_low"), F.when(interval, part(F.col("ci_high"))).alias("pfpkm_high"),
        F.when(ok & (F.col("host_reads") > 0), F.col("lambda") * F.col("reads") / F.col("host_reads")).alias("host_ratio"),
    )


def path(blocks: Column, strand: Column, nt: Column) -> Column:
    """Genomic positions in translation order, as many as nt. blocks: array of (start0, end0) in genome order."""
    flat = F.flatten(F.transform(blocks, lambda b: F.sequence(b["start0"], b["end0"] - 1)))
    return F.slice(F.when(strand == "-", F.reverse(flat)).otherwise(flat), F.lit(1), nt)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at == 0, n.cast("long")).otherwise(at - 1)


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor by Euclid's steps."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def integrate(calls: DataFrame, replicates: list[str], least: int = 2, least_share: float = 0.5, fdr: float = 0.05) -> DataFrame:
    """calls(key, replicate, q, lambda, primary): a row for each key, with its support and label; wide presence columns."""
    n = len(replicates)
    agg = calls.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_observed"), F.sum("primary").alias("n_primary"), F.count_if(F.col("q") <= fdr).alias("n_bh"), F.median(finite(F.col("lambda"))).alias("median_lambda"), F.min(finite(F.col("q"))).alias("min_q"),
        *[F.max(F.when(F.col("replicate") == r, F.col("primary"))).alias(f"primary_{r}") for r in replicates],
    )
    few = F.when(F.col("n_primary") > 0, "single_replicate_primary_credible").otherwise("not_primary_credible")
    many = F.when((F.col("n_primary") >= least) & (F.col("n_primary") >= least_share * n), "reproducible_primary_credible").when(F.col("n_primary") > 0, "primary_credible_not_reproducible").otherwise("not_primary_credible")
    return agg.withColumn("label", few if n < least else many)


def pairwise(values: DataFrame) -> DataFrame:
    """values(key, replicate, x): for each pair of replicates, shared keys, Pearson and Spearman correlation, median absolute difference.

    There are a few replicates, and a key has one value in each, so the join on the key is no group of pairs. Ranks
    are taken over distinct values with their counts, as running totals, so no task ranks all keys of a pair."""
    from codonlake.functions import skew

    a, b = (values.select("key", F.col("replicate").alias(f"rep_{s}"), F.col("x").alias(s)) for s in "ab")
    both = a.join(b, "key").filter("rep_a < rep_b")
    both = both.withColumn("pair", F.concat_ws("|", "rep_a", "rep_b"))
    for s in "ab":
        values = both.groupBy("pair", s).agg(F.count(F.lit(1)).alias("k"))
        ranked = skew.running(skew.ranges(values, "pair", s), "pair", s, F.col("k"), "upto")
        both = both.join(ranked.select("pair", s, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{s}")), ["pair", s])
    enough = F.count(F.lit(1)) >= 2
    return both.groupBy("rep_a", "rep_b").agg(
        F.count(F.lit(1)).alias("n"), F.when(enough, pearson(F.col("a"), F.col("b"))).alias("pearson"), F.when(enough, pearson(F.col("ra"), F.col("rb"))).alias("spearman"), F.median(F.abs(F.col("a") - F.col("b"))).alias("median_diff")
    )


def support_combinations(calls: DataFrame) -> DataFrame:
    """supporting (joined replicate names), n: keys by the set of replicates that call them primary."""
    sets = calls.filter("primary = 1").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("replicate")), "+").alias("supporting"))
    return sets.groupBy("supporting").agg(F.count(F.lit(1)).alias("n"))


def waterfall(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """step, gate, n: rows that pass each gate and all before it."""
    counts, so_far = [], F.lit(True)
    for name, gate in [("all", F.lit(True)), *gates]:
        so_far = so_far & F.coalesce(gate, F.lit(False))
        counts.append((name, F.count_if(so_far)))
    one = rows.agg(*[c.alias(f"_{k}") for k, (_, c) in enumerate(counts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("gate"), F.col(f"_{k}").alias("n")) for k, (name, _) in enumerate(counts)])))


def length_bins(rows: DataFrame, length: str, flag: Column) -> DataFrame:
    """bin, n, passing: counts by length bin; empty bins stay."""
    edges = [(9, "6-9"), (14, "10-14"), (29, "15-29"), (59, "30-59")]
    label = F.lit(">=60")
    for top, name in reversed(edges):
        label = F.when(F.col(length) <= top, name).otherwise(label)
    seen = rows.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("passing"))
    names = rows.sparkSession.createDataFrame([(n,) for n in [x[1] for x in edges] + [">=60"]], "bin string")
    return names.join(seen, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("passing", F.lit(0)).alias("passing"))

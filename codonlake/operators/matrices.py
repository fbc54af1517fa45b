"""Gates, combinations, and wide matrices over replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.functions.sqlx import finite, pearson


def margin(value: Column, limit: float, above: bool = True) -> Column:
    """Distance from a gate's limit as a share of it, positive where the gate passes; -2 for what is no number."""
    v = finite(value)
    return F.coalesce(((v - limit) if above else (limit - v)) / abs(limit), F.lit(-2.0))


def combinations(rows: DataFrame, gates: Sequence[str]) -> DataFrame:
    """Counts by which gates (boolean columns) pass, and the rank of each: most rows first, then those that pass more."""
    x = rows.groupBy(*[F.col(g).cast("int").alias(g) for g in gates]).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are combinations
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), *[F.desc(g) for g in gates])))


def wide(values: DataFrame, replicates: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """values(key, replicate, x, primary): a row for each key that any replicate calls primary, a column for each replicate.

    Values outside the limits and no numbers stay blank; keys without any value go. support: replicates that call
    it primary; middle: the median of its values."""
    v = finite(F.col("x"))
    v = F.when(v >= low, v) if low is not None else v
    v = F.when(v <= high, v) if high is not None else v
    x = values.withColumn("_v", v).groupBy("key").agg(
        F.count_if(F.col("primary") == 1).alias("support"), F.median("_v").alias("middle"), *[F.max(F.when(F.col("replicate") == r, F.col("_v"))).alias(r) for r in replicates]
    )
    return x.filter("support > 0 and middle is not null")


def states(calls: DataFrame, replicates: Sequence[str], available: Sequence[str]) -> DataFrame:
    """key and for each replicate 2 where it is primary, 1 where seen, 0 where not, -1 for a replicate without a table."""
    cell = lambda r: F.lit(-1) if r not in available else F.coalesce(F.max(F.when(F.col("replicate") == r, F.when(F.col("primary") == 1, 2).otherwise(1))), F.lit(0))
    return calls.groupBy("key").agg(*[cell(r).alias(r) for r in replicates])


def correlations(values: DataFrame, replicates: Sequence[str]) -> DataFrame:
    """rep_a, rep_b, n, pearson of log2(1 + x) over the keys that both have; one aggregation over the wide table."""
    logs = values.groupBy("key").agg(*[F.max(F.when(F.col("replicate") == r, F.log2(1 + finite(F.col("x"))))).alias(f"_{k}") for k, r in enumerate(replicates)])
    pairs = [(i, j) for i in range(len(replicates)) for j in range(i + 1, len(replicates))]
    both = lambda i, j: F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull()
    side = lambda i, j, k: F.when(both(i, j), F.col(f"_{k}"))
    one = logs.agg(*[c for i, j in pairs for c in (F.count_if(both(i, j)).alias(f"n{i}_{j}"), pearson(side(i, j, i), side(i, j, j)).alias(f"r{i}_{j}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(replicates[i]).alias("rep_a"), F.lit(replicates[j]).alias("rep_b"), F.col(f"n{i}_{j}").alias("n"), F.col(f"r{i}_{j}").alias("pearson")) for i, j in pairs])))


def labels(rows: DataFrame, base: Column, kind: Column, name: Column) -> DataFrame:
    """Adds `label`: the base, with kind and the last six characters of the name where several rows have the same base."""
    several = F.count(F.lit(1)).over(W.partitionBy(base)) > 1
    return rows.withColumn("label", F.when(several, F.concat(base, F.lit(" "), kind, F.lit(" "), F.right(name, F.lit(6)))).otherwise(base))

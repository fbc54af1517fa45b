"""Joins that bear hot keys, and running totals that no single task works out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept

#: A key counts as hot from this share of the rows on, so fewer than 1 / HOT_SHARE keys do; parts that a hot key is dealt to.
HOT_SHARE, PARTS = 0.001, 64


def small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the table's size, as files, is under its limit for broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that a thousandth of the rows or more have: at most 1,000."""
    least = max(64.0, rows.count() * HOT_SHARE)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key)


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "left", hot: DataFrame | None = None, broadcast: bool = True) -> DataFrame:
    """rows joined with a lookup of unique keys, where one key may be on a third of the rows.

    A lookup that is small by its files is broadcast, unless the plan shall be alike at every size. Beyond that, rows of hot keys (bounded in number, so those
    keys are broadcast) are dealt to parts by the column `by`, and those keys' lookups are repeated for each part."""
    if broadcast and small(lookup):
        return rows.join(F.broadcast(lookup), key, how)
    hot = F.broadcast((hot_keys(rows, key) if hot is None else hot).withColumn("_hot", F.lit(True)))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(0).cast("int")).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, key, "left").withColumn("_part", F.explode(every)).drop("_hot")
    return dealt.join(repeated.hint("merge"), [key, "_part"], how).drop("_part")


def ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt by ranges of the order and kept, with the range's number `_range`: equal values of the first
    columns can be in several ranges, and a range's number outlasts a lost executor."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def running(dealt: DataFrame, family: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of the value over the family's rows up to each one, ties of the order included.

    dealt: from `ranges(rows, family, order)`, where no two rows of a family tie. A window sees one range of a family;
    the totals of earlier ranges come from a table of one row for each family and range."""
    by, inner = [family, "_range"], W.partitionBy(family, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(family).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return dealt.withColumn("_inner", F.sum(value).over(inner)).join(before, by).withColumn(name, F.col("_inner") + F.col("_before")).drop("_inner", "_before")


def least_from(dealt: DataFrame, family: str, order: str, value: str, name: str) -> DataFrame:
    """Adds the least value over the family's rows from each one on, in the order. dealt as for `running`."""
    by, inner = [family, "_range"], W.partitionBy(family, "_range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    lows = dealt.groupBy(*by).agg(F.min(value).alias("_low"))
    after = lows.withColumn("_after", F.min("_low").over(W.partitionBy(family).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1))).drop("_low")
    return dealt.withColumn("_inner", F.min(value).over(inner)).join(after, by).withColumn(name, F.least("_inner", "_after")).drop("_inner", "_after")

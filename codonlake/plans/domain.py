"""Deterministic adapters from the test tables to the domain tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.sources.tables import table

PSITE_SQL = """psite AS (
  SELECT event_type AS chrom, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
         event_id * 7919 % 3000 AS pos, 25 + user_id % 9 AS rl
  FROM events)"""

#: Two blocks for customers with an even key: the second starts 10 bases after the first ends.
BLOCK_SQL = """chroms AS (
  SELECT event_type AS chrom, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
spans AS (
  SELECT c_custkey AS orf, c_custkey * 31 % 2700 AS s, 30 + 3 * (c_custkey % 40) AS len,
         c_nationkey % 5 AS k, CASE WHEN (c_nationkey // 5) % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM customer),
block AS (
  SELECT orf, chrom, strand, 0 AS block, s AS start0, CASE WHEN orf % 2 = 0 THEN s + 16 ELSE s + len END AS end0, len
  FROM spans JOIN chroms USING (k)
  UNION ALL
  SELECT orf, chrom, strand, 1, s + 26, s + len + 10, len FROM spans JOIN chroms USING (k) WHERE orf % 2 = 0)"""


def psites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("chrom"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("event_id") * 7919 % 3000).alias("pos"),
        (25 + F.col("user_id") % 9).alias("rl"),
    )


def orf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    # a handful of event types: the window sees one row for each
    chroms = names.withColumn("k", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("long"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("orf"),
        (F.col("c_custkey") * 31 % 2700).alias("s"),
        (30 + 3 * (F.col("c_custkey") % 40)).alias("len"),
        (F.col("c_nationkey") % 5).cast("long").alias("k"),
        F.when(F.expr("(c_nationkey div 5) % 2 = 0"), "+").otherwise("-").alias("strand"),
    )
    split = F.col("orf") % 2 == 0
    parts = F.when(
        split,
        F.array(
            F.struct(F.lit(0).alias("block"), F.col("s").alias("start0"), (F.col("s") + 16).alias("end0")),
            F.struct(F.lit(1).alias("block"), (F.col("s") + 26).alias("start0"), (F.col("s") + F.col("len") + 10).alias("end0")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("block"), F.col("s").alias("start0"), (F.col("s") + F.col("len")).alias("end0"))))
    return c.join(chroms, "k").select("orf", "chrom", "strand", "len", F.inline(parts))

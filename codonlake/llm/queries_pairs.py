"""Registered queries of the operators that relate documents to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import line_dedup, ngram_join
from codonlake.llm.shared import table


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_groups(table(spark, sf_dir, "documents"), k=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.with_deletions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "text")


QUERIES = {"op3_ngram_join": op3_ngram_join, "op6_line_dedup": op6_line_dedup}
ORACLES: dict[str, str] = {}

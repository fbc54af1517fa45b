"""P-site counting over ORF blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators import intervals
from codonlake.plans import domain


def iv_site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.site_index(domain.psites(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = intervals.with_offsets(domain.orf_blocks(spark, sf_dir))
    return intervals.range_join(iv_site_index(spark, sf_dir), blocks)


def codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.codon_counts(hits(spark, sf_dir).withColumn("n_codons", F.expr("len div 3")))


def iv_codon_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codons(spark, sf_dir).withColumn("n", F.col("c0") + F.col("c1") + F.col("c2"))


CODON_SQL = f"""WITH {domain.PSITE_SQL}, {domain.BLOCK_SQL},
site AS (SELECT chrom, strand, pos, count(*) AS n FROM psite GROUP BY ALL),
placed AS (
  SELECT *, coalesce(sum(end0 - start0) OVER (
    PARTITION BY orf ORDER BY CASE WHEN strand = '+' THEN start0 ELSE -start0 END
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM block),
hit AS (
  SELECT p.orf, p.len, s.n,
         off + CASE WHEN p.strand = '+' THEN pos - start0 ELSE end0 - 1 - pos END AS t
  FROM site s JOIN placed p ON s.chrom = p.chrom AND s.strand = p.strand AND pos >= start0 AND pos < end0),
codon AS (
  SELECT orf, CAST(t // 3 AS BIGINT) AS codon,
         CAST(sum(CASE WHEN t % 3 = 0 THEN n ELSE 0 END) AS BIGINT) AS c0,
         CAST(sum(CASE WHEN t % 3 = 1 THEN n ELSE 0 END) AS BIGINT) AS c1,
         CAST(sum(CASE WHEN t % 3 = 2 THEN n ELSE 0 END) AS BIGINT) AS c2
  FROM hit WHERE t // 3 < len // 3 GROUP BY orf, t // 3)"""

QUERIES = {"iv_site_index": iv_site_index, "iv_codon_phase_counts": iv_codon_phase_counts}
ORACLES = {
    "iv_site_index": f"WITH {domain.PSITE_SQL} SELECT chrom, strand, pos, count(*) AS n FROM psite GROUP BY ALL",
    "iv_codon_phase_counts": f"{CODON_SQL} SELECT orf, codon, c0, c1, c2, c0 + c1 + c2 AS n FROM codon",
}

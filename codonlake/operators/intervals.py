"""Interval operators: binned range join and codon counting.

P-sites are points and ORF blocks are intervals. A block is exploded to the
fixed-width bins it touches, a site has exactly one bin, so the range join
becomes an equi-join on (chrom, strand, bin) with a residual predicate and
needs no de-duplication. Both sides are pre-aggregated or narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About a block's length, so that a block is compared with few sites outside it, however many blocks there are.
BIN = 128


def site_index(psites: DataFrame) -> DataFrame:
    """Reads per (chrom, strand, pos)."""
    return psites.groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("n"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """blocks(orf, chrom, strand, block, start0, end0): adds `offset`, the ORF index of the block's
    first base in translation order, so on the minus strand blocks count from the last."""
    from pyspark.sql import Window

    order = F.when(F.col("strand") == "+", F.col("start0")).otherwise(-F.col("start0"))
    w = Window.partitionBy("orf").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(F.col("end0") - F.col("start0")).over(w), F.lit(0)))


def range_join(sites: DataFrame, blocks: DataFrame, width: int = BIN) -> DataFrame:
    """Sites inside blocks: start0 <= pos < end0, same chrom and strand, with the ORF index `t`."""
    binned = blocks.withColumn("bin", F.explode(F.sequence(F.expr(f"start0 div {width}"), F.expr(f"(end0 - 1) div {width}"))))
    hit = sites.withColumn("bin", F.expr(f"pos div {width}")).join(binned, ["chrom", "strand", "bin"])
    hit = hit.filter((F.col("pos") >= F.col("start0")) & (F.col("pos") < F.col("end0")))
    inside = F.when(F.col("strand") == "+", F.col("pos") - F.col("start0")).otherwise(F.col("end0") - 1 - F.col("pos"))
    return hit.withColumn("t", F.col("offset") + inside).drop("bin")


def codon_counts(hits: DataFrame, n_codons: str = "n_codons") -> DataFrame:
    """(orf, codon) with the reads of the three phases; a trailing partial codon is left out."""
    t = F.col("t")
    reads = lambda p: F.sum(F.when(t % 3 == p, F.col("n")).otherwise(0)).cast("long").alias(f"c{p}")
    return (
        hits.withColumn("codon", F.expr("t div 3"))
        .filter(F.col("codon") < F.col(n_codons))
        .groupBy("orf", "codon")
        .agg(reads(0), reads(1), reads(2))
    )

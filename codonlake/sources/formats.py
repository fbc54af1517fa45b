"""Readers of annotation and alignment formats: GTF, SAM text, FASTA lines, tables of strings, offset dictionaries."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attribute(attributes: Column, key: str) -> Column:
    """The last quoted value of a key; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(attributes, F.lit(f'(?:^|[;\\s]){key} "([^"]*)"'), F.lit(1)), F.lit(-1))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with 0-based half-open coordinates and `line`, their order; blank lines, comments and short lines are left out."""
    x = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter("trim(value) <> '' and value not like '#%'").select(F.split("value", "\t").alias("c"), "line").filter("size(c) >= 9")
    x = x.select(F.assert_true(F.size("c") == 9, "a GTF line has more than 9 fields").alias("_ok"), "c", "line")
    a = F.col("c")[8]
    names = [attribute(a, k).alias(k) for k in ("gene_id", "transcript_id", "gene_name", "transcript_name")]
    kinds = [F.coalesce(attribute(a, f"{k}_biotype"), attribute(a, f"{k}_type")).alias(f"{k}_biotype") for k in ("gene", "transcript")]
    tags = F.regexp_extract_all(a, F.lit('(?:^|[;\\s])tag "([^"]*)"'), F.lit(1)).alias("tags")
    c = F.col("c")
    return x.filter("_ok is null").select(c[0].alias("chrom"), c[2].alias("feature"), (c[3].cast("int") - 1).alias("start0"), c[4].cast("int").alias("end0"), c[6].alias("strand"), *names, *kinds, tags, "line")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text: qname, flag, rname, pos0, mapq, cigar, seq, md, nh."""
    x = spark.read.text(path).filter("value not like '@%'").select(F.split("value", "\t").alias("c"))
    c = F.col("c")
    return x.select(
        c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("rname"), (c[3].cast("long") - 1).alias("pos0"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("seq"),
        F.get(F.filter("c", lambda t: t.startswith("MD:Z:")), F.lit(0)).substr(6, 1 << 20).alias("md"), F.get(F.filter("c", lambda t: t.startswith("NH:i:")), F.lit(0)).substr(6, 12).cast("int").alias("nh"),
    )


def read_tsv(spark: SparkSession, path: str | list[str], required: set[str]) -> DataFrame:
    """A table of strings with a header; a missing column is an error."""
    out = spark.read.option("sep", "\t").option("header", True).csv(path)
    if missing := sorted(required - set(out.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def write_bed(sites: DataFrame, path: str) -> None:
    """chrom, start, end, name, score, strand of each P-site, in order of place."""
    rows = sites.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.lit(".").alias("name"), F.col("n").alias("score"), "strand")
    rows.orderBy("chrom", "start", "strand").write.mode("overwrite").option("sep", "\t").csv(path)


def length_offsets(text: str) -> dict[int, int]:
    """Offsets by read length from `L:O` parts between commas or white space."""
    out: dict[int, int] = {}
    for part in text.replace(",", " ").split():
        a, _, b = part.partition(":")
        length, offset = int(a), int(b)
        if length <= 0 or not 0 <= offset < length or length in out:
            raise ValueError(f"bad or repeated length and offset: {part}")
        out[length] = offset
    return out


def offset_dict(source: str) -> dict[int, int]:
    """The integer part of an `offdict = {...}` assignment, read as a literal and never run."""
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "offdict" for t in node.targets):
            found = ast.literal_eval(node.value)
            return {k: v for k, v in found.items() if isinstance(k, int) and not isinstance(k, bool)}
    raise ValueError("there is no offdict")

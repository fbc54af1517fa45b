"""FASTA sequences as a table of pieces, their index, and slices and spliced transcripts of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bases of a piece of a sequence.
PIECE = 1 << 14


def read_fai(spark: SparkSession, fasta: str) -> DataFrame:
    """chrom, length of the contigs of an indexed FASTA; a missing index is an error."""
    rows = spark.read.option("sep", "\t").schema("chrom string, length long, at long, bases int, bytes int").csv(f"{fasta}.fai")
    return rows.filter("chrom is not null").select("chrom", "length")


def whitelist(contigs: DataFrame, primary_only: bool = False) -> DataFrame:
    """chrom of the contigs to keep; none left is an error."""
    from codonlake.operators.orfs import contig_class

    kept = contigs.filter(contig_class(F.col("chrom")) == "primary") if primary_only else contigs
    kept = kept.select("chrom").distinct()
    if kept.isEmpty():
        raise ValueError("no contig is left")
    return kept


def read_fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """chrom, piece, seq: upper-case bases by pieces of fixed length, made from the index's line lengths.

    Lines are read by Spark with their place in the file; the index tells which contig a place belongs to, so no task
    needs to read a contig from its start. Every line of a contig but the last has the same length."""
    index = spark.read.option("sep", "\t").schema("chrom string, length long, at long, bases int, bytes int").csv(f"{path}.fai").filter("length > 0")
    text = spark.read.format("text").option("lineSep", "\n").load(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    # a block's lines follow each other; the last line that a block begins in belongs to the block before
    size = F.length("value") + 1
    w = W.partitionBy("block").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    placed = text.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    totals = text.groupBy("block").agg(F.sum(size).alias("bytes_of"))
    starts = totals.withColumn("from", F.coalesce(F.sum("bytes_of").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row for each block
    lines = placed.join(F.broadcast(starts.select("block", "from")), "block").select((F.col("from") + F.col("before")).alias("place"), "value").filter("value not like '>%' and value <> ''")
    ends = index.withColumn("end", F.expr("at + ((length - 1) div bases) * bytes + (length - 1) % bases + 1"))
    span = 1 << 22
    binned = ends.withColumn("bin", F.explode(F.expr(f"sequence(at div {span}, (end - 1) div {span})")))  # a row for each contig and 4 MB
    own = lines.withColumn("bin", F.expr(f"place div {span}")).join(F.broadcast(binned), "bin").filter("place >= at and place < end")
    bases = own.select("chrom", F.expr("((place - at) div bytes) * bases").alias("start"), F.upper(F.regexp_replace("value", r"\s", "")).alias("seq"))
    return to_pieces(bases, piece)


def byte_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (chrom, start, end: bases from 0, half-open) with `first` and `n`: the bytes of the file that hold them.

    Bases outside a contig are left out, as are contigs that the index lacks."""
    index = spark.read.option("sep", "\t").schema("chrom string, length long, at long, bases int, bytes int").csv(f"{path}.fai").filter("length > 0")
    byte = lambda x: f"at + ({x} div bases) * bytes + {x} % bases"
    x = wanted.join(index, "chrom").withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "length")).filter("start < end")
    return x.withColumn("first", F.expr(byte("start"))).withColumn("n", F.expr(f"{byte('(end - 1)')} + 1 - first")).drop("length", "at", "bases", "bytes")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (chrom, start, end and other columns) with seq, upper-case: only the bytes of the wanted bases are read, each range by itself."""
    from codonlake.sources.bam import place

    ranges = byte_ranges(spark, path, wanted)
    ranges = ranges.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "first").sortWithinPartitions("first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = place(path)
        with system.open_input_file(inner) as file:
            for batch in batches:
                out = []
                for at, n in zip(batch.column("first").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    file.seek(at)
                    out.append(file.read(n).translate(None, b"\r\n\t ").decode().upper())
                kept = [i for i, name in enumerate(batch.schema.names) if name not in ("first", "n")]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(out, pa.string())], names=[*[batch.schema.names[i] for i in kept], "seq"])

    kept = [f for f in ranges.schema.fields if f.name not in ("first", "n")]
    return ranges.mapInArrow(read, StructType([*kept, StructField("seq", StringType())]))


def read_contigs(spark: SparkSession, path: str, contigs: Sequence[str], piece: int = PIECE) -> DataFrame:
    """chrom, piece, seq as `read_fasta`, of some contigs, by the index's byte ranges: nothing else of the file is read."""
    chosen = read_fai(spark, path).filter(F.col("chrom").isin(*contigs) & (F.col("length") > 0))
    wanted = chosen.select("chrom", F.explode(F.expr(f"sequence(0L, (length - 1) div {piece})")).alias("piece"))
    wanted = wanted.select("chrom", "piece", (F.col("piece") * piece).alias("start"), ((F.col("piece") + 1) * piece).alias("end"))
    return read_ranges(spark, path, wanted).select("chrom", "piece", "seq")


def to_pieces(parts: DataFrame, piece: int = PIECE) -> DataFrame:
    """chrom, piece, seq from parts (chrom, start, seq) that cover a contig without gaps."""
    n = F.length("seq")
    cut = parts.filter(n > 0).withColumn("piece", F.explode(F.expr(f"sequence(start div {piece}, (start + length(seq) - 1) div {piece})")))
    lo = F.greatest(F.lit(0).cast("long"), F.col("piece") * piece - F.col("start"))
    hi = F.least(n.cast("long"), (F.col("piece") + 1) * piece - F.col("start"))
    cut = cut.select("chrom", "piece", F.struct((F.col("start") + lo).alias("s"), F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("seq")).alias("x"))
    return cut.groupBy("chrom", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["seq"]), "").alias("seq"))


def slices(pieces: DataFrame, ranges: DataFrame, key: str, piece: int = PIECE) -> DataFrame:
    """The ranges' columns (key, chrom, start0, end0, ...) with seq: the bases from start0 to end0; what lies outside the contig is missing.

    An equi-join on pieces: a range is sent once for each piece that it touches."""
    x = ranges.withColumn("piece", F.explode(F.expr(f"sequence(start0 div {piece}, greatest(start0, end0 - 1) div {piece})")))
    lo = F.greatest(F.lit(0).cast("long"), F.col("start0") - F.col("piece") * piece)
    hi = F.least(F.lit(piece).cast("long"), F.col("end0") - F.col("piece") * piece)
    hit = x.join(pieces.withColumnRenamed("seq", "_seq"), ["chrom", "piece"]).withColumn("_part", F.struct("piece", F.substring("_seq", (lo + 1).cast("int"), F.greatest(F.lit(0).cast("long"), hi - lo).cast("int")).alias("s")))
    joined = hit.groupBy(key, "chrom", "start0", "end0").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["s"]), "").alias("seq"))
    return ranges.join(joined, [key, "chrom", "start0", "end0"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def splice(pieces: DataFrame, transcripts: DataFrame, key: str = "transcript_id", piece: int = PIECE) -> DataFrame:
    """transcripts (key, chrom, strand, exons) with seq: exons in transcript order, on the minus strand from the other one."""
    exons = transcripts.select(key, "chrom", "strand", F.explode("exons").alias("x")).select(key, "chrom", "strand", F.col("x.s").alias("start0"), F.col("x.e").alias("end0"))
    found = slices(pieces, exons, key, piece)
    return transcripts.join(found.groupBy(key).agg(spliced().alias("seq")), key, "left")


def spliced() -> Column:
    """An aggregate over slices (start0, seq, strand) of one transcript: its sequence."""
    from codonlake.operators.orfs import reverse_complement

    forward = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start0", "seq"))), lambda p: p["seq"]), "")
    return F.when(F.max("strand") == "-", reverse_complement(forward)).otherwise(forward)

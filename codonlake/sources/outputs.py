"""Sinks: tables of text, FASTA, alignments of one base, reports and manifests, each complete or not there."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text(c: Column, kind: str, digits: int = 10) -> Column:
    """A value as text: numbers with so many digits (with an exponent only where they are very small or large), what is no number empty, truth as 0 or 1."""
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit(""))
    if kind in ("double", "float"):
        d = c.cast("double")
        short = F.format_string(f"%.{digits - 1}e", d)  # d.ddde+xx
        whole = F.substring_index(short, "e", -1).cast("int")
        trim = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
        exponent = F.concat(trim(F.substring_index(short, "e", 1)), F.lit("e"), F.when(whole < 0, "-").otherwise("+"), F.lpad(F.abs(whole).cast("string"), 2, "0"))
        near = F.coalesce(*[F.when(whole == k, trim(F.format_string(f"%.{max(0, digits - 1 - k)}f", d))) for k in range(-4, digits)])
        return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), "").when(d == 0, "0").otherwise(F.coalesce(near, exponent))
    return F.coalesce(c.cast("string"), F.lit(""))


def as_text(df: DataFrame, digits: int = 10) -> DataFrame:
    return df.select(*[text(F.col(f"`{f.name}`"), f.dataType.simpleString(), digits).alias(f.name) for f in df.schema.fields])


def write_tsv(df: DataFrame, path: str, order: Sequence[Column | str] = (), compressed: bool = False, digits: int = 10) -> None:
    """A folder of tab-separated parts with a header, in the order asked for; written beside and moved, so no reader sees half of it."""
    out = as_text(df.orderBy(*order) if order else df, digits)
    _moved(df.sparkSession, path, lambda to: out.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("compression", "gzip" if compressed else "none").csv(to))


def write_one(df: DataFrame, path: str, order: Sequence[Column | str] = (), digits: int = 10) -> None:
    """As `write_tsv`, in one part: for reports and other tables that are bounded."""
    write_tsv(df.coalesce(1) if not order else df.orderBy(*order).coalesce(1), path, (), False, digits)


def _moved(spark: SparkSession, path: str, write) -> None:
    """Writes beside the path, puts an old result aside and the new one in its place; a failure leaves the old one there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside, old, to = hadoop.Path(f"{path}.tmp-{uuid.uuid4().hex}"), hadoop.Path(f"{path}.old-{uuid.uuid4().hex}"), hadoop.Path(path)
    system = to.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(aside.toString())
        there = system.exists(to)
        if there and not system.rename(to, old):
            raise OSError(f"can't put the old result aside: {path}")
        if not system.rename(aside, to):
            if there:
                system.rename(old, to)
            raise OSError(f"can't move the result to {path}")
        system.delete(old, True)
    finally:
        system.delete(aside, True)


def clear(spark: SparkSession, *paths: str) -> None:
    """Deletes outputs of an earlier run, so that a failed one leaves none of them beside its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of text, in the order it has."""
    _moved(lines.sparkSession, path, lines.write.text)


def write_faa(rows: DataFrame, path: str, name: str = "torf_id", peptide: str = "peptide") -> None:
    """Peptides as FASTA, two lines each; rows without peptide are left out."""
    lines = rows.filter(F.coalesce(F.col(peptide), F.lit("")) != "").select(F.concat(F.lit(">"), name, F.lit("\n"), peptide).alias("value"))
    _moved(rows.sparkSession, path, lines.write.text)


def write_torfs(rows: DataFrame, path: str) -> None:
    """tORFs as Parquet by chromosome; the text table and FASTA come from it."""
    _moved(rows.sparkSession, path, lambda to: rows.write.partitionBy("chrom").parquet(to))


def write_gorfs(gorfs: DataFrame, members: DataFrame, path: str) -> None:
    """Genomic ORFs and their members, after the checks that ids and signatures belong to each other."""
    twice = gorfs.groupBy("gorf_id").agg(F.count_distinct("gorf_signature").alias("n"), F.count(F.lit(1)).alias("k")).filter("n > 1 or k > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an id comes twice: {twice[0].gorf_id}")
    if lost := members.select("gorf_id").distinct().join(gorfs, "gorf_id", "left_anti").limit(1).collect():
        raise ValueError(f"members of no genomic ORF: {lost[0].gorf_id}")
    write_tsv(gorfs, f"{path}.gorf.tsv")
    write_tsv(members, f"{path}.gorf_members.tsv")
    write_faa(gorfs, f"{path}.gorf.faa", "gorf_id")


def with_gorf_ids(torfs: DataFrame, members: DataFrame) -> DataFrame:
    """tORFs with their genomic ORF; one without stops the job."""
    x = torfs.drop("gorf_id").join(members.select(F.col("torf").alias("torf_id"), "gorf_id"), "torf_id", "left")
    lost = F.raise_error(F.concat(F.lit("no genomic ORF for "), "torf_id")).cast("string")
    return x.withColumn("gorf_id", F.when(F.col("gorf_id").isNull(), lost).otherwise(F.col("gorf_id")))


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """Shards of one table; other columns, or another order of them, are an error."""
    if not parts:
        raise ValueError("there are no parts")
    if any(p.columns != parts[0].columns for p in parts):
        raise ValueError("the parts have unlike headers")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_alignments(records: DataFrame, path: str, contigs: Sequence[tuple[str, int]]) -> None:
    """Alignments of one base (`psites.records`) as SAM text in order of place, header first."""
    tag = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:i:"), F.col(c).cast("string")))
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", (F.col("pos0") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual", *[tag(c) for c in ("OL", "AL", "PO", "RL", "NH")])
    place = F.element_at(F.create_map(*[F.lit(v) for k, (n, _) in enumerate(contigs) for v in (n, k)]), F.col("rname")) if contigs else F.lit(0)
    head = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs]]
    spark = records.sparkSession
    top = spark.createDataFrame([(-1, k, "", x) for k, x in enumerate(head)], "c long, p long, q string, value string")
    rows = records.select(place.cast("long").alias("c"), F.col("pos0").cast("long").alias("p"), F.col("qname").alias("q"), line.alias("value"))
    _moved(spark, path, lambda to: top.union(rows).orderBy("c", "p", "q").select("value").write.text(to))


def write_counts(histogram: DataFrame, path: str) -> None:
    """rel_nt and count of a zero-filled histogram, in order."""
    write_one(histogram, path, ["rel_nt"])


def write_key_values(rows: Sequence[tuple[str, object]], spark: SparkSession, path: str, header: tuple[str, str] = ("metric", "value")) -> None:
    """Names and values, in order."""
    value = lambda v: "" if v is None or v != v else f"{v:.10g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    df = spark.createDataFrame([(k, name, value(v)) for k, (name, v) in enumerate(rows)], f"place int, {header[0]} string, {header[1]} string")
    _moved(spark, path, lambda to: df.orderBy("place").select(*header).coalesce(1).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(to))


def write_manifest(spark: SparkSession, path: str, content: Mapping) -> None:
    """A JSON object, keys in order."""
    line = json.dumps(content, indent=2, sort_keys=True, default=str)
    _moved(spark, path, lambda to: spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(to))


def manifest(program: str, version: str, parameters: Mapping, inputs: Mapping, result: DataFrame, outputs: Sequence[Mapping]) -> dict:
    """What a run was made from, and what it made: enough for later runs to tell whether they fit."""
    return {"program": program, "version": version, "parameters": dict(parameters), "inputs": dict(inputs), "output_schema": result.columns, "result_rows": result.count(), "outputs": [dict(o) for o in outputs]}


#: Bytes of a file that one task hashes.
PIECE = 64 << 20


def identity(spark: SparkSession, path: str, known: Mapping | None = None) -> dict:
    """Path, size, time of change and SHA-256 of a file, or of a folder's files in order of name.

    Files are hashed in pieces, each by a task of its own; a file of one piece has its plain SHA-256, any other the SHA-256
    of its pieces' hashes one after another. known: an earlier identity, which holds where size and time are the same."""
    from pyarrow import fs

    from codonlake.sources.bam import place

    system, inner = place(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return {"path": path, "exists": False, "size_bytes": 0, "mtime": None, "sha256": ""}
    found = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
    size, mtime = sum(f.size for f in found), max((f.mtime_ns or 0 for f in found), default=0)
    if known and known.get("exists") and (known.get("size_bytes"), known.get("mtime")) == (size, mtime):
        return dict(known)
    pieces = [(k, f.path, at, min(PIECE, f.size - at)) for k, f in enumerate(found) for at in range(0, max(f.size, 1), PIECE)]

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            digests = []
            for name, at, n in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                with place(path)[0].open_input_file(name) as file:
                    file.seek(at)
                    digests.append(hashlib.sha256(file.read(n)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests)], names=["file", "at", "sha"])

    rows = spark.createDataFrame(pieces, "file int, path string, at long, n long") if pieces else spark.createDataFrame([], "file int, path string, at long, n long")
    rows = rows.repartition(max(1, min(len(pieces), 1000)), "file", "at") if len(pieces) > 1 else rows
    digests = [r.sha for r in sorted(rows.mapInArrow(hashed, "file int, at long, sha string").collect(), key=lambda r: (r.file, r.at))]  # one for 64 MB
    whole = digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest()
    return {"path": path, "exists": True, "size_bytes": size, "mtime": mtime, "sha256": whole}

"""BAM output: a folder of whole files with indexes, in order of place, and one file of such a folder.

Rows are dealt by ranges of (contig, place) and sorted, and each task writes one file (header, blocks, end) and its index
under a name of its own. Only when all tasks are done are the files moved to their names; a failed write leaves nothing.
The columns are those of alignments; columns with names of two characters become tags.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import IntegralType, StringType, StructType

from codonlake.sources import bam, bam_index

#: Unpacked bytes of a block, at most; bytes that are copied at once.
BLOCK, PIECE = 65_280, 8 << 20
FIXED = ("qname", "flag", "rname", "pos0", "mapq", "cigar", "seq", "qual")
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_CODES = {c: i for i, c in enumerate(bam.BASES)}


def block(data: bytes) -> bytes:
    """A gzip member that names its own size."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def head(contigs: Sequence[tuple[str, int]], text: str = "") -> bytes:
    """The blocks before the first record."""
    lines = text or "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    data = b"BAM\1" + struct.pack("<i", len(lines.encode())) + lines.encode() + struct.pack("<i", len(contigs))
    data += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"".join(block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))


def encoded(row: dict, contigs: dict[str, int], tags: Sequence[tuple[str, str]]) -> tuple[bytes, int, int, int]:
    """A record's bytes, its contig, its first base and its bases on the contig."""
    name, seq, ops = row["qname"].encode(), "" if row["seq"] in (None, "*") else row["seq"], [(int(n), o) for n, o in _CIGAR.findall(row["cigar"] or "")]
    if len(name) > 254 or len(ops) > 0xFFFF:
        raise ValueError(f"a record that the format can't hold: {row['qname'][:80]}")
    if row["rname"] not in (None, "*") and row["rname"] not in contigs:
        raise ValueError(f"a contig that the header lacks: {row['rname']}")
    contig, pos = contigs.get(row["rname"], -1), row["pos0"] if row["rname"] in contigs else -1
    span = sum(n for n, o in ops if o in "MDN=X")
    codes = [_CODES.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    qual = row["qual"]
    scores = bytes(ord(c) - 33 for c in qual) if qual not in (None, "*") and len(qual) == len(seq) else b"\xff" * len(seq)
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name) + 1, min(row["mapq"], 255), bam_index.bin_of(max(pos, 0), max(pos, 0) + max(span, 1)) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), -1, -1, 0)
    body += name + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + scores
    for column, kind in tags:
        value = row[column]
        if value is not None:
            body += column.upper().encode() + (b"i" + struct.pack("<i", value) if kind == "i" else b"Z" + value.encode() + b"\0")
    return struct.pack("<i", len(body)) + body, contig, pos, span


class File:
    """Records written in order to an open file, and their index."""

    def __init__(self, file, contigs: Sequence[tuple[str, int]]) -> None:
        self.file, self.held = file, bytearray()
        first = head(contigs)
        self.file.write(first)
        self.place, self.head = len(first), len(first)
        self.built, self.waiting = bam_index.Builder(len(contigs)), []
        self.last = (-1, -1)
        self.rows = 0

    def add(self, data: bytes, contig: int, pos: int, span: int, mapped: bool) -> None:
        order = (contig if contig >= 0 else 1 << 40, pos)
        if order < self.last:
            raise ValueError("records come out of order")
        self.last = order
        if self.held and len(self.held) + len(data) > BLOCK:
            self._flush()
        start = self.place << 16 | len(self.held)
        self.held += data
        while len(self.held) > BLOCK:  # a record larger than a block
            self._write(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]
        if len(self.held) == BLOCK:
            self._flush()
        self.built.add(contig, pos, span, mapped, start, self.place << 16 | len(self.held))
        self.rows += 1

    def _write(self, data: bytes) -> None:
        out = block(data)
        self.file.write(out)
        self.place += len(out)

    def _flush(self) -> None:
        if self.held:
            self._write(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self._flush()
        self.file.write(bam.END)


@dataclass
class Written(WriterCommitMessage):
    """Where a task's file is, and its place among the others."""

    part: int
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, contigs: list[tuple[str, int]], overwrite: bool) -> None:
        self.path, self.contigs, self.overwrite, self.run = path, contigs, overwrite, uuid.uuid4().hex
        if missing := [c for c in FIXED if c not in schema.names]:
            raise ValueError(f"alignments lack columns: {', '.join(missing)}")
        self.tags = []
        for f in schema.fields:
            if f.name in FIXED:
                continue
            if len(f.name) != 2 or not isinstance(f.dataType, IntegralType | StringType):
                raise ValueError(f"no tag can hold the column {f.name}")
            self.tags.append((f.name, "Z" if isinstance(f.dataType, StringType) else "i"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = bam.place(self.path)
        context = TaskContext.get()
        system.create_dir(f"{inner}/_temporary-{self.run}", recursive=True)
        path = f"{inner}/_temporary-{self.run}/{context.partitionId()}-{context.taskAttemptId()}"
        numbers = {n: k for k, (n, _) in enumerate(self.contigs)}
        with system.open_output_stream(path, compression=None) as out:
            file = File(out, self.contigs)
            for batch in iterator:
                for row in batch.to_pylist():
                    data, contig, pos, span = encoded(row, numbers, self.tags)
                    file.add(data, contig, pos, span, not row["flag"] & 4)
            file.close()
        with system.open_output_stream(f"{path}.bai", compression=None) as out:
            out.write(bam_index.packed(file.built.index))
        return Written(context.partitionId(), path, file.rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, inner = bam.place(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith(("part-", "_SUCCESS"))]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"there are files in {self.path}")
        for path in old:
            system.delete_file(path)
        wrote = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        kept = [m for m in wrote if m.rows] or wrote[:1]
        for k, m in enumerate(kept):
            system.move(m.path, f"{inner}/part-{k:05}.bam")
            system.move(f"{m.path}.bai", f"{inner}/part-{k:05}.bam.bai")
        system.delete_dir(f"{inner}/_temporary-{self.run}")
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, inner = bam.place(self.path)
        if system.get_file_info(f"{inner}/_temporary-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_temporary-{self.run}")


class Sorted(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, [(n, int(size)) for n, size in json.loads(self.options["contigs"])], overwrite)


def write_bam(alignments: DataFrame, path: str, contigs: Sequence[tuple[str, int]], overwrite: bool = True) -> None:
    """The alignments in order of contig (as given), place and name, as a folder of files with indexes.

    Unmapped records without contig stand last. An empty table gives one file without records."""
    spark = alignments.sparkSession
    spark.dataSource.register(Sorted)
    numbers = F.create_map(*[F.lit(v) for k, (n, _) in enumerate(contigs) for v in (n, k)]) if contigs else F.create_map().cast("map<string,int>")
    rank = F.coalesce(F.try_element_at(numbers, F.col("rname")), F.when(F.col("rname") == "*", 1 << 30).otherwise(-1))
    order = ["_rank", "pos0", "qname"]
    dealt = alignments.withColumn("_rank", rank).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("_rank")
    dealt.write.format("bam_files").option("contigs", json.dumps([list(c) for c in contigs])).mode("overwrite" if overwrite else "append").save(path)


def join_files(folder: str, path: str) -> bam_index.Index:
    """One file, with its index, of a folder that `write_bam` wrote: blocks are copied as they are, a bounded piece at a time.

    For results that one machine is to open elsewhere; the folder itself is read as one table."""
    system, inner = bam.place(folder)
    to, target = bam.place(path)
    parts, at, contigs = [], 0, None
    aside = f"{target}.tmp-{uuid.uuid4().hex}"
    with to.open_output_stream(aside, compression=None) as out:
        for name, index_path in bam.files(folder):
            with system.open_input_file(name) as file:
                s = bam.Blocks(file)
                own = bam.header(s)
                begin = s.tell() >> 16
                if contigs is None:
                    contigs, first = own, 0
                elif own != contigs:
                    raise ValueError("the files have unlike headers")
                else:
                    first = begin
                parts.append((at - first, bam.read_index(index_path, system)))
                file.seek(first)
                left = file.size() - len(bam.END) - first
                while left:
                    data = file.read(min(PIECE, left))
                    out.write(data)
                    left -= len(data)
                    at += len(data)
        out.write(bam.END)
    index = bam_index.joined(parts, len(contigs or []))
    with to.open_output_stream(f"{target}.bai", compression=None) as out:
        out.write(bam_index.packed(index))
    to.move(aside, target)
    return index

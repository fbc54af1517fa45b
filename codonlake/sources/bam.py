"""A batch data source of BAM files: `spark.read.format("bam").load(path)` after `register(spark)`.

A file with an index beside it (`x.bam.bai` or `x.bai`) is cut at offsets that the index names, about `splitBytes` of the file
for each task, and a filter on `rname`, with or without bounds of `pos0`, reads only the chunks that the index gives for
it. A file without index is one task. Blocks and records are read as a stream, in batches of bounded size, so memory
doesn't grow with the file. The columns are those of `formats.read_sam`.

Spark evaluates all filters again on what is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from codonlake.sources import bam_index

SCHEMA = "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, md string, nh int"
_ARROW = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos0", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("md", pa.string()), ("nh", pa.int32())])
#: Letters of the format's codes. Fixed values.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Bytes of a tag's value by its type. Fixed values.
WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
WHOLE = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
ROWS = 20_000
#: Fixed value: the empty block that ends a whole file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a file for one task, unless the option says otherwise.
SPLIT = 64 << 20


class Stream:
    """The unpacked bytes of a file of gzip members."""

    def __init__(self, file) -> None:
        self.file, self.held, self.rest, self.unpack = file, bytearray(), b"", zlib.decompressobj(31)

    def read(self, n: int, whole: bool = True) -> bytes:
        """The next n bytes; fewer only at the end, which is an error where `whole`."""
        while len(self.held) < n:
            data = self.rest or self.file.read(1 << 18)
            if not data:
                break
            self.held += self.unpack.decompress(data)
            self.rest = self.unpack.unused_data
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
        out = bytes(self.held[:n])
        del self.held[:n]
        if len(out) < n and (whole or out):
            raise ValueError("the BAM file ends inside a record")
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def tags(data: bytes) -> Iterator[tuple[str, object]]:
    """Tags with a whole number or text; others are passed over."""
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield name, data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + WIDTH[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            if kind in WHOLE:
                yield name, struct.unpack_from(WHOLE[kind], data, at)[0]
            at += WIDTH[kind]


def record(data: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*"
    at += 4 * n_ops
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] or "*"
    found = dict(tags(data[at + len(packed) + l_seq :]))
    return data[32 : 31 + l_name].decode(), flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, found.get("MD"), found.get("NH")


class Blocks:
    """The unpacked bytes of a file of BGZF blocks from an offset on; `tell` is the virtual offset of the next byte."""

    def __init__(self, file, offset: int = 0) -> None:
        self.file, self.place, self.data, self.at = file, offset >> 16, b"", 0
        file.seek(self.place)
        self.following = self.place
        if offset & 0xFFFF:
            self._block()
            self.at = offset & 0xFFFF

    def _block(self) -> bool:
        """The next block; false at the end of the file."""
        head = self.file.read(18)
        if not head:
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
            raise ValueError("the BAM file ends inside a block, or has other bytes than blocks")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        rest = self.file.read(size - 18)
        if len(rest) < size - 18:
            raise ValueError("the BAM file ends inside a block")
        self.place, self.following, self.at = self.following, self.following + size, 0
        self.data = zlib.decompress(rest[:-8], -15)
        if len(self.data) != struct.unpack_from("<I", rest, len(rest) - 4)[0]:
            raise ValueError("a block of the BAM file is damaged")
        return True

    def tell(self) -> int:
        return self.following << 16 if self.at == len(self.data) else self.place << 16 | self.at

    def read(self, n: int, whole: bool = True) -> bytes:
        """The next n bytes; fewer only at the end, which is an error where `whole`."""
        out = b""
        while len(out) < n:
            if self.at == len(self.data) and not self._block():
                break
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        if len(out) < n and (whole or out):
            raise ValueError("the BAM file ends inside a record")
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def header(s: Stream | Blocks) -> list[tuple[str, int]]:
    """The contigs and their lengths; the stream stands at the first record afterwards."""
    if s.read(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s.read(s.number())
    return [(s.read(s.number())[:-1].decode(), s.number()) for _ in range(s.number())]


def records(file) -> Iterator[tuple]:
    """All records of a file, one after another. A file of blocks without the block that ends it is cut."""
    start = file.read(18)
    blocks = start[12:14] == b"BC"
    if blocks:
        file.seek(-len(END), 2)
        if file.read() != END:
            raise ValueError("the BAM file has no end")
    file.seek(0)
    s = Stream(file)
    names = [name for name, _ in header(s)]
    while size := s.read(4, whole=False):
        yield record(s.read(struct.unpack("<i", size)[0]), names)


def between(file, chunks: list[tuple[int, int | None]]) -> Iterator[tuple]:
    """The records that begin in chunks of virtual offsets, in order; None: up to the end of the file."""
    names = [name for name, _ in header(Blocks(file))]
    for a, z in chunks:
        s = Blocks(file, a)
        while z is None or s.tell() < z:
            size = s.read(4, whole=z is not None)
            if not size:
                break
            yield record(s.read(struct.unpack("<i", size)[0]), names)


@dataclass
class Part(InputPartition):
    """What one task reads: chunks of virtual offsets of a file, or (None) the whole file."""

    path: str
    chunks: list[tuple[int, int | None]] | None


def split(chunks: list[tuple[int, int | None]], cuts: list[int], size: int) -> list[list[tuple[int, int | None]]]:
    """The chunks dealt to tasks of about `size` bytes each; chunks are cut only at the given offsets."""
    pieces = []
    for a, z in chunks:
        inside = [x for x in cuts if a < x and (z is None or x < z)]
        last = a
        for x in inside:
            if (x >> 16) - (last >> 16) >= size:
                pieces.append((last, x))
                last = x
        pieces.append((last, z))
    out: list[list[tuple[int, int | None]]] = []
    held = 0
    for a, z in pieces:
        own = size if z is None else (z >> 16) - (a >> 16)
        if out and held + own <= size:
            out[-1].append((a, z))
            held += own
        else:
            out.append([(a, z)])
            held = own
    return out


def place(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, str | None]]:
    """(file, its index or None) of a BAM file, or of those in a folder in order of name."""
    from pyarrow import fs

    system, inner = place(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no BAM files in {path}")
    all_paths = {f.path for f in system.get_file_info(fs.FileSelector(inner))} if info.type == fs.FileType.Directory else {inner}
    found = sorted(p for p in all_paths if p.endswith(".bam") or p == inner and info.type == fs.FileType.File)
    if not found:
        raise ValueError(f"no BAM files in {path}")
    beside = lambda p: [f"{p}.bai", f"{p.removesuffix('.bam')}.bai"]
    there = lambda p: p in all_paths if info.type == fs.FileType.Directory else system.get_file_info(p).type == fs.FileType.File
    return [(p, next((x for x in beside(p) if there(x)), None)) for p in found]


def read_index(path: str, system) -> bam_index.Index:
    with system.open_input_stream(path, compression=None) as file:
        return bam_index.parsed(file.read())


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.names: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Contigs and bounds of the place choose chunks; all filters are left to Spark, since chunks hold neighbours too."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "rname" and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif column == "pos0" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value + (not isinstance(f, LessThan))  # half-open
                    self.high = high if self.high is None else min(self.high, high)
            yield f

    def partitions(self) -> list[InputPartition]:
        system, _ = place(self.path)
        out: list[InputPartition] = []
        for path, index_path in files(self.path):
            if index_path is None:
                out.append(Part(path, None))
                continue
            index = read_index(index_path, system)
            with system.open_input_file(path) as file:
                file.seek(max(0, file.size() - len(END)))
                if file.read() != END:
                    raise ValueError(f"the BAM file has no end: {path}")
                first = Blocks(file)
                contigs = [name for name, _ in header(first)]
                begin = first.tell()
            if len(contigs) != len(index.contigs):
                raise ValueError(f"the index is of another file: {path}")
            chunks: list[tuple[int, int | None]] = [(begin, None)]
            # records without contig have a negative place: they stand after all others
            if self.names is not None and "*" not in self.names:
                chunks = list(bam_index.merged(c for name, own in zip(contigs, index.contigs, strict=True) if name in self.names for c in own.chunks(self.low, self.high)))
            out += [Part(path, own) for own in split(chunks, index.cuts(), self.size)]
        return out or [Part("", [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.chunks == []:
            return
        system, _ = place(self.path)
        with system.open_input_file(partition.path) as file:
            held = []
            for row in records(file) if partition.chunks is None else between(file, partition.chunks):
                held.append(row)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        size = int(self.options.get("splitBytes", SPLIT))
        if size <= 0:
            raise ValueError("splitBytes must be positive")
        return Reader(self.options["path"], size)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach sources that are written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bam)


def read(spark: SparkSession, path: str, contigs: Iterable[str] = (), split_bytes: int = SPLIT) -> DataFrame:
    """The records of a BAM file or of a folder of them, on request only of some contigs."""
    register(spark)
    out = spark.read.format("bam").option("splitBytes", split_bytes).load(path)
    wanted = list(contigs)
    return out.filter(out.rname.isin(wanted)) if wanted else out


def indexed_counts(path: str) -> list[tuple[str, int, int]] | None:
    """(contig, mapped, unmapped) of the files' indexes, without reading a record; None where a file has none."""
    system, _ = place(path)
    out: dict[str, tuple[int, int]] = {}
    for file_path, index_path in files(path):
        if index_path is None:
            return None
        with system.open_input_file(file_path) as file:
            names = [name for name, _ in header(Blocks(file))]
        for name, mapped, unmapped in bam_index.counts(read_index(index_path, system), names):
            a, b = out.get(name, (0, 0))
            out[name] = a + mapped, b + unmapped
    return [(name, *n) for name, n in out.items()]

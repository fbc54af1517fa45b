"""The BAM source against files written byte by byte."""

import gzip
import os
import random
import re
import struct

import pytest
from codonlake.sources import bam, bam_index, bam_output, inputs
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan


def written(path, rows):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, ops, seq, extra in rows:
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHi", ref, pos, len(name) + 1, 30, 0, len(ops), flag, len(seq)) + struct.pack("<iii", -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + b"\xff" * len(seq) + extra
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    path.write_bytes(gzip.compress(out[:half]) + gzip.compress(out[half:]) + gzip.compress(b""))


def test_records(spark, tmp_path):
    extra = b"NHC\x02" + b"XBBs" + struct.pack("<I", 2) + b"\1\0\2\0" + b"XAAq" + b"MDZ3A1\0"
    written(tmp_path / "a.bam", [("r1", 16, 0, 99, [(2, "S"), (3, "M")], "ACGTN", extra), ("r2", 4, -1, -1, [], "", b"")])
    written(tmp_path / "b.bam", [])
    bam.register(spark)
    got = sorted(tuple(r) for r in spark.read.format("bam").load(str(tmp_path)).collect())
    assert got == [("r1", 16, "chr1", 99, 30, "2S3M", "ACGTN", "3A1", 2), ("r2", 4, "*", -1, 30, "*", "*", None, None)]


def test_cut_file_is_an_error(tmp_path):
    written(tmp_path / "a.bam", [("r1", 0, 0, 5, [(3, "M")], "ACG", b"")])
    data = gzip.decompress((tmp_path / "a.bam").read_bytes())
    (tmp_path / "c.bam").write_bytes(gzip.compress(data[:-4]))
    with pytest.raises(ValueError, match="inside a record"):
        list(bam.records((tmp_path / "c.bam").open("rb")))


CONTIGS = [("chr2", 400_000_000), ("chr10", 90_000), ("none", 10)]


def alignments(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        rname = rng.choice(["chr2", "chr2", "chr10", "*"])
        pos = -1 if rname == "*" else rng.choice([rng.randrange(80_000), rng.randrange(60_000, 61_000)]) + (rng.choice([0, 200_000_000]) if rname == "chr2" else 0)
        cigar = "*" if rname == "*" else rng.choice(["28M", "10M5000N18M", "2S26M", "1M"])
        size = 0 if rname == "*" else sum(int(k) for k, o in re.findall(r"(\d+)([MS])", cigar))
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        out.append((f"r{i}", rng.choice([0, 16]) if rname != "*" else 4, rname, pos, rng.randrange(60), cigar, seq, "I" * size or "*", rng.choice([None, "28", "3A24"]), rng.choice([None, 1, 7])))
    return out


@pytest.fixture(scope="module")
def written_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    rows = alignments(9000)
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, qual string, MD string, NH int").repartition(6)
    bam_output.write_bam(df, f"{folder}/parts", CONTIGS)
    bam_output.join_files(f"{folder}/parts", f"{folder}/one.bam")
    return folder, rows


def plain(rows):
    return sorted((q, f, r, p, m, c, s, md, nh) for q, f, r, p, m, c, s, _, md, nh in rows)


def test_written_files_read_back_for_any_split(spark, written_files):
    folder, rows = written_files
    for path in (f"{folder}/parts", f"{folder}/one.bam"):
        seen = set()
        for size in (1, 20_000, 1 << 30):
            df = bam.read(spark, path, split_bytes=size)
            seen.add(df.rdd.getNumPartitions())
            assert sorted(tuple(r) for r in df.collect()) == plain(rows)
        assert len(seen) == 3 if path.endswith("one.bam") else len(seen) >= 2
    with open(f"{folder}/one.bam", "rb") as file:
        found = [(r[2], r[3]) for r in bam.records(file)]
    assert found == sorted(found, key=lambda x: (["chr2", "chr10", "*"].index(x[0]), x[1])) and len(found) == len(rows)


def test_contigs_and_places_read_few_blocks(spark, written_files, monkeypatch):
    folder, rows = written_files
    path = f"{folder}/one.bam"
    df = bam.read(spark, path, split_bytes=1 << 14)
    cases = [
        (df.filter("rname = 'chr10'"), lambda r: r[2] == "chr10"), (df.filter("rname in ('chr10', 'none')"), lambda r: r[2] == "chr10"), (df.filter("rname = '*'"), lambda r: r[2] == "*"),
        (df.filter("rname = 'chr2' and pos0 >= 60500 and pos0 < 60700"), lambda r: r[2] == "chr2" and 60500 <= r[3] < 60700), (df.filter("rname = 'chr2' and pos0 = 60501"), lambda r: r[2] == "chr2" and r[3] == 60501),
        (df.filter("rname = 'chr2' and pos0 > 199999999"), lambda r: r[2] == "chr2" and r[3] > 199999999), (df.filter("rname = 'missing'"), lambda r: False), (df.filter("pos0 < 5"), lambda r: r[3] < 5),
    ]
    for found, keep in cases:
        assert sorted(tuple(r) for r in found.collect()) == [r for r in plain(rows) if keep(r)]
    assert bam.read(spark, path, ["chr10"]).count() == sum(r[2] == "chr10" for r in rows)
    # what a filter reads, in bytes of the file

    def parts(*filters):
        reader = bam.Reader(path, 1 << 14)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return reader.partitions()

    size = os.path.getsize(path)
    span = lambda ps: sum(((size << 16 if z is None else z) >> 16) - (a >> 16) for p in ps for a, z in p.chunks)
    whole, narrow = span(parts()), span(parts(EqualTo(("rname",), "chr2"), GreaterThanOrEqual(("pos0",), 70_000), LessThan(("pos0",), 70_100)))
    assert whole > 0.9 * size and narrow < whole / 5 and span(parts(EqualTo(("rname",), "chr10"))) < whole / 2
    assert parts(EqualTo(("rname",), "missing"))[0].chunks == []


def test_counts_come_from_the_index(spark, written_files, monkeypatch):
    folder, rows = written_files
    monkeypatch.setattr(bam, "record", None)
    for path in (f"{folder}/parts", f"{folder}/one.bam"):
        assert {r.contig: (r.mapped, r.unmapped) for r in inputs.alignment_summary(spark, path).collect()} == {n: (sum(r[2] == n for r in rows), 0) for n, _ in CONTIGS}
        assert inputs.library_size(None, path) == sum(r[2] != "*" for r in rows)


def test_cut_and_foreign_files_are_errors(spark, written_files, tmp_path):
    folder, _ = written_files
    data, index = (folder / "one.bam").read_bytes(), (folder / "one.bam.bai").read_bytes()
    for k, bad in enumerate((data[:-28], data[:-100], data[: len(data) // 2])):
        (tmp_path / f"{k}.bam").write_bytes(bad)
        with pytest.raises(Exception, match="no end"):
            bam.read(spark, str(tmp_path / f"{k}.bam")).count()
        (tmp_path / f"{k}.bam.bai").write_bytes(index)
        with pytest.raises(Exception, match="no end"):
            bam.read(spark, str(tmp_path / f"{k}.bam")).count()
    (tmp_path / "x.bam").write_bytes(data[:60_000] + b"\0" + data[60_001:])
    (tmp_path / "x.bam.bai").write_bytes(index)
    with pytest.raises(Exception, match="damaged|block|incorrect|invalid"):
        bam.read(spark, str(tmp_path / "x.bam")).count()
    with pytest.raises(ValueError, match="too early"):
        bam_index.parsed(index[:40])
    assert bam_index.packed(bam_index.parsed(index)) == index
    with pytest.raises(Exception, match="header lacks"):
        bam_output.write_bam(spark.createDataFrame([("r", 0, "chrX", 1, 1, "1M", "A", "I")], "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, qual string"), str(tmp_path / "bad"), CONTIGS)
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    none = spark.createDataFrame([], "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, qual string")
    bam_output.write_bam(none, str(tmp_path / "none"), CONTIGS)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0


def test_bins():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.randrange(1 << 29)
        b = min(1 << 29, a + rng.choice([1, 50, 20_000, 1 << 22]))
        own = bam_index.bin_of(a, b)
        assert own in set(bam_index.bins_of(a, b)) and own in set(bam_index.bins_of(b - 1, b))
    assert bam_index.bin_of(0, 1) == 4681 and bam_index.bin_of(0, 1 << 29) == 0 and bam_index.first_bins() == [0, 1, 9, 73, 585, 4681]

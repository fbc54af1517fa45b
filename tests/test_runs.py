"""A whole run on a made genome: annotation, sequences and alignments in, results and reports out."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from codonlake.__main__ import main
from codonlake.operators import orfs, orfscan
from codonlake.plans import files, pipeline
from codonlake.sources import bam, fasta, inputs, outputs
from pyspark.sql import functions as F

CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in orfs.STOPS]
COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    """Twelve genes of two exons on one contig, in turn on both strands; reads with most ends in phase 0 of the CDS."""
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("genome")
    chrom, gtf, reads = [rng.choice("ACGT") for _ in range(16_000)], [], []
    for g in range(12):
        coding = "ATG" + "".join(rng.choice(CODONS) for _ in range(200)) + "TAA"
        tx = "".join(rng.choice("AC") for _ in range(40)) + coding + "".join(rng.choice("AC") for _ in range(40))
        start, gap, cut = 300 + 1300 * g, 120, 333
        minus = g % 2 == 1
        text = tx[::-1].translate(COMPLEMENT) if minus else tx
        place = [start + i + (gap if i >= cut else 0) for i in range(len(text))]
        for i, p in enumerate(place):
            chrom[p] = text[i]
        at = place[::-1] if minus else place  # genomic place of each transcript base

        def pieces(a, b, at=at):
            """1-based closed pieces of a transcript range, in order of the genome."""
            out = []
            for p in sorted(at[a:b]):
                if out and out[-1][1] == p:
                    out[-1][1] = p + 1
                else:
                    out.append([p + 1, p + 1])
            return out

        strand, name = "-" if minus else "+", f'gene_id "G{g}"; transcript_id "T{g}"; gene_name "N{g}"; gene_biotype "protein_coding"; tag "MANE_Select"; tag "CCDS";'
        for feature, a, b in (("transcript", 0, len(tx)), ("exon", 0, len(tx)), ("CDS", 40, 40 + len(coding) - 3), ("start_codon", 40, 43), ("stop_codon", 40 + len(coding) - 3, 40 + len(coding))):
            found = pieces(a, b) if feature != "transcript" else [[min(at) + 1, max(at) + 1]]
            gtf += ["\t".join(("chr1", "x", feature, str(s), str(e), ".", strand, ".", name)) for s, e in found]
        for k in range(900):
            t = 40 + 3 * rng.randrange(len(coding) // 3 - 12) + rng.choices((0, 1, 2), (80, 12, 8))[0]
            a, b = t - 12, t + 16
            if a < 0:
                continue
            spots = sorted(at[a:b])
            runs = [[spots[0], 1]]
            cigar = ""
            for p, q in zip(spots, spots[1:]):
                if q == p + 1:
                    runs[-1][1] += 1
                else:
                    cigar += f"{runs[-1][1]}M{q - p - 1}N"
                    runs.append([q, 1])
            cigar += f"{runs[-1][1]}M"
            reads.append("\t".join((f"r{g}-{k}", "16" if minus else "0", "chr1", str(spots[0] + 1), "60", cigar, "*", "0", "0", "".join(chrom[p] for p in spots), "I" * 28, "NH:i:1", "MD:Z:28")))
    seq = "".join(chrom)
    lines = [seq[i : i + 60] for i in range(0, len(seq), 60)]
    (folder / "g.fa").write_text(">chr1 made\n" + "\n".join(lines) + "\n>chrUn_x\nACGT\n")
    (folder / "g.fa.fai").write_text(f"chr1\t{len(seq)}\t11\t60\t61\nchrUn_x\t4\t{11 + len(seq) + len(lines) + 9}\t4\t5\n")
    (folder / "g.gtf").write_text("# made\n\n" + "\n".join(gtf) + "\n")
    (folder / "r.sam").write_text("@SQ\tSN:chr1\tLN:16000\n" + "\n".join(reads) + "\n")
    return folder, seq


def test_sequences_come_back(spark, genome):
    folder, seq = genome
    pieces = fasta.read_fasta(spark, f"{folder}/g.fa", 100)
    rows = {(r.chrom, r.piece): r.seq for r in pieces.collect()}
    assert "".join(rows["chr1", k] for k in range(160)) == seq and rows["chrUn_x", 0] == "ACGT"
    assert [r.chrom for r in fasta.whitelist(fasta.read_fai(spark, f"{folder}/g.fa"), True).collect()] == ["chr1"]


def test_run_from_annotation_to_reports(spark, genome, tmp_path):
    folder, _ = genome
    c = pipeline.Config(sample="s1", folder=str(tmp_path), gtf=f"{folder}/g.gtf", fasta=f"{folder}/g.fa", alignments=f"{folder}/r.sam", length_offsets={28: 12}, min_density=0.01, min_aa=8, with_codon=True, export="all")
    done = pipeline.run(spark, c)
    assert all(state == "run" for _, state in done) and len(done) == 17
    read = lambda name: spark.read.parquet(f"{tmp_path}/s1/{name}/data")
    torf = read("torf")
    assert set(torf.columns) == {*orfscan.COLUMNS, "line"} and torf.select("line").distinct().count() == torf.count()
    assert [r.transcript_id for r in torf.groupBy("transcript_id").agg(F.min("line").alias("line")).orderBy("line").collect()] == [f"T{g}" for g in range(12)]
    own = torf.filter("is_annotated_cds = 1").collect()
    assert {r.transcript_id for r in own} == {f"T{g}" for g in range(12)}
    assert all(r.orf_biotype == "CDS" and r.peptide_len == 201 and r.peptide[0] == "M" and r.aa_len == 201 and r.blockCount == 2 and r.has_MANE_Select_tag == 1 for r in own)
    assert orfs.passed(orfs.audit(orfscan.for_collapse(torf), read("gorf_members"), read("gorf")))
    assert read("psite").count() > 9000 and {r.RL for r in read("psite").select("RL").distinct().collect()} == {28}
    back = read("background").first()
    assert back.template_status == "success" and abs(back.pi0 - 0.8) < 0.05 and back.A > 1
    metrics = read("cds_metrics").collect()
    assert len(metrics) == 12 and all(0.7 < r.PIF < 0.9 for r in metrics)
    found = read("accurate_results")
    assert found.count() > 0 and found.filter("q_BH < 0 or q_BH > 1 or p_final is null or classification is null").count() == 0
    fitted = found.filter("lambda_hat is not null").collect()
    assert fitted and sum(r.lambda_hat < 0.1 for r in fitted) > 0.8 * len(fitted)
    assert read("accurate_context").count() == found.count() and read("accurate_codons").count() > 0 and read("accurate_gate_waterfall").count() == 7
    assert all(state == "kept" for _, state in pipeline.run(spark, c))
    again = dict(pipeline.run(spark, pipeline.replace_settings(c, fdr=0.01), dry=True))
    assert again["torf"] == again["background"] == "kept" and again["accurate_results"] == "would run"
    row = pipeline.summary_row(spark, c, "accurate", "complete")
    assert row["selected_length_offsets"] == "28:12" and int(row["psite_alignments"]) > 9000
    assert [r.candidate_order for r in found.orderBy("candidate_order").collect()] == sorted(r.candidate_order for r in found.collect())
    trimmed = pipeline.replace_settings(c, sample="s2", pi_method="trimmed", to_stage="qc", gtf=c.gtf)
    assert dict(pipeline.run(spark, trimmed))["background"] == "run"
    small = pipeline.replace_settings(trimmed, sample="s3", trim_reservoir=50)
    assert dict(pipeline.run(spark, small, shared=f"{tmp_path}/annotation"))["background"] == "run"
    means = [spark.read.parquet(f"{tmp_path}/{n}/background/data").first() for n in ("s1", "s2", "s3")]
    assert all(abs(m.pi0 - 0.8) < 0.12 for m in means) and len({m.pi0 for m in means}) == 3
    made = files.write_files(spark, c)
    assert {n.split(".", 1)[0] for n in made} >= {"torf", "gorf", "psite", "dm_background", "intorf_dm_results", "run_manifest", "orf_psite_codons", "gate_waterfall"}
    text = lambda n: spark.read.option("sep", "\t").option("header", True).csv(made[n])
    assert text("torf.tsv").count() == torf.count() and text("gorf_members.tsv").count() == torf.count() and text("intorf_dm_results.tsv").count() == found.count()
    assert [r.torf_id for r in text("torf.tsv").select("torf_id", F.input_file_name().alias("f")).collect()] == [r.torf_id for r in torf.orderBy("line").collect()]
    back = bam.read(spark, made["psite.bam"])
    assert sorted((r.qname, r.pos0, r.flag) for r in back.collect()) == sorted((r.qname, r.pos0, r.flag) for r in read("psite").collect())
    assert inputs.library_size(None, made["psite.bam"]) == read("psite").count() == spark.read.text(made["psite.bed"]).count()
    depth = [r.value.split("\t") for n in ("plus", "minus") for r in spark.read.text(made[f"psite.{n}.bedGraph"]).collect()]
    assert sum((int(e) - int(s)) * abs(int(d)) for _, s, e, d in depth) == read("psite").count()
    said = spark.read.option("multiLine", True).json(made["run_manifest.json"]).first()
    assert said.result_rows == found.count() and said.inputs.alignments.sha256 == outputs.identity(spark, f"{folder}/r.sam")["sha256"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s1" / "files" / "s1.torf.by_chrom").rglob("*.parquet")}
    files.add_by_chrom(torf.withColumn("chrom", F.lit("chr9")).withColumn("torf_id", F.concat(F.lit("x"), "torf_id")), made["torf.by_chrom"], "torf_id")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and spark.read.parquet(made["torf.by_chrom"]).count() == 2 * torf.count()
    with pytest.raises(ValueError, match="another chromosome"):
        files.add_by_chrom(torf.limit(1).withColumn("chrom", F.lit("chr8")), made["torf.by_chrom"], "torf_id")
    other = pipeline.replace_settings(c, sample="other", fdr=0.01)
    (tmp_path / "other").mkdir()
    for name in ("torf", "accurate_results"):
        shutil.copytree(tmp_path / "s1" / name, tmp_path / "other" / name)
    record = next((tmp_path / "other" / "accurate_results" / "record").glob("part-*"))
    record.write_text(record.read_text().replace('"signature": "', '"signature": "0'))
    (record.parent / f".{record.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="doesn't fit"):
        pipeline.integration(spark, [c, other])
    tables = pipeline.integration(spark, [c, pipeline.replace_settings(c, sample="gone")])
    assert tables["consensus"].count() == tables["long"].count() == found.count()
    assert {r.label.split("\n")[0] for r in tables["quality_labels"].collect()} == {"s1", "gone"}
    assert {(r.replicate_id, r.total) for r in tables["call_counts"].collect()} == {("s1", found.count()), ("gone", 0)}
    assert tables["abundance"].count() == tables["consensus"].filter("n_primary_credible > 0").count()


def test_configurations_that_cannot_run():
    good = pipeline.Config(sample="s", folder="f", length_offsets={28: 12})
    assert good.checked() is good
    for bad in ({"sample": "a b"}, {"mode": "x"}, {"length_offsets": {}}, {"offset_file": "o"}, {"from_stage": "dm", "to_stage": "qc"}, {"from_stage": "x"}, {"min_aa": 0}, {"starts": ("AUG",)}, {"chroms": "chr1"}, {"merge_by": "x"}):
        with pytest.raises(ValueError, match=r"\w"):
            pipeline.replace_settings(good, **bad).checked()
    names = [s.name for _, _, s in pipeline.stages(pipeline.replace_settings(good, mode="both"))]
    assert "fast_results" in names and "accurate_results" in names and "accurate_codons" not in names and names.count("torf") == 1


def test_command_line(spark, genome, tmp_path, capsys):
    folder, _ = genome
    args = ["run", "--folder", str(tmp_path), "--gtf", f"{folder}/g.gtf", "--fasta", f"{folder}/g.fa", "--alignments", f"{folder}/r.sam", "--length-offsets", "28:12", "--to-stage", "psite", "--set", "min_mapq=30"]
    assert main(args, spark) == 0 and capsys.readouterr().out.splitlines()[-1] == "psite\trun"
    assert main([*args, "--dry-run"], spark) == 0 and "would run" not in capsys.readouterr().out
    assert main([*args, "--set", "nonsense=1"], spark) == 2
    assert main(["run", "--folder", str(tmp_path), "--sample", "stops", *args[3:9], "--length-offsets", "28:12", "--to-stage", "orfscan", "--merge-by", "stop", "--no-files"], spark) == 0
    assert {r.merge_by for r in spark.read.parquet(f"{tmp_path}/stops/gorf/data").select("merge_by").distinct().collect()} == {"stop"}
    plain = subprocess.run([sys.executable, "-m", "codonlake", *args[:9], "--length-offsets", "28:12", "--dry-run"], capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"})
    assert plain.returncode == 0 and plain.stdout.splitlines()[-1] == "accurate_gate_waterfall\twould run" and plain.stdout.splitlines()[0] == "torf\tkept"
    good = pipeline.Config(sample="good", folder=str(tmp_path), gtf=f"{folder}/g.gtf", fasta=f"{folder}/g.fa", alignments=f"{folder}/r.sam", length_offsets={28: 12}, to_stage="psite")
    batch = pipeline.run_batch(spark, [good, pipeline.replace_settings(good, sample="bad", gtf=f"{folder}/none.gtf")])
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "annotation").iterdir()) == ["gorf", "gorf_audit", "gorf_members", "torf"]
    assert [r["status"].split(":")[0] for r in batch] == ["complete", "failed"] and batch[1]["psite_alignments"] == ""


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, True, None), ("b", float("nan"), False, 3), ("c", 1 / 3, None, 4), ("d", 1.25e-7, True, 5), ("e", 1234567.0, True, 6), ("f", -0.5, True, 6), ("g", 2e15, True, 7), ("h", 0.0, True, 8)], "k string, x double, ok boolean, n int")
    outputs.write_one(rows, f"{tmp_path}/t.tsv", ["k"])
    back = [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t.tsv").orderBy("k").collect()]
    plain = lambda v: None if v != v else f"{v:.10g}"
    assert [r[1] for r in back] == [plain(r.x) for r in rows.orderBy("k").collect()]
    assert [r[2] for r in back][:3] == ["1", "0", None] and [r[3] for r in back][:2] == [None, "3"]
    outputs.write_one(rows.limit(1), f"{tmp_path}/t.tsv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t.tsv").count() == 1  # replaced, not added to
    outputs.write_faa(spark.createDataFrame([("t1", "MA"), ("t2", "")], "torf_id string, peptide string"), f"{tmp_path}/p.faa")
    assert [r.value for r in spark.read.text(f"{tmp_path}/p.faa").collect()] == [">t1", "MA"]
    records = spark.createDataFrame([("r", 16, "chr2", 4, 60, "1M", "A", "I", 28, 28, 12, 28, None), ("q", 0, "chr1", 9, 60, "1M", "C", "I", 28, 28, 12, 28, 1)], "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, qual string, OL int, AL int, PO int, RL int, NH int")
    outputs.write_alignments(records, f"{tmp_path}/a.sam", [("chr1", 100), ("chr2", 50)])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/a.sam").collect()]
    assert lines[0].startswith("@HD") and sorted(lines)[-2:] == ["q\t0\tchr1\t10\t60\t1M\t*\t0\t0\tC\tI\tOL:i:28\tAL:i:28\tPO:i:12\tRL:i:28\tNH:i:1", "r\t16\tchr2\t5\t60\t1M\t*\t0\t0\tA\tI\tOL:i:28\tAL:i:28\tPO:i:12\tRL:i:28"]
    outputs.write_manifest(spark, f"{tmp_path}/m", outputs.manifest("p", "1", {"a": 1}, {}, rows, [outputs.identity(spark, f"{tmp_path}/a.sam")]))
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/m").first().result_rows == 8
    outputs.write_key_values([("a", 1.0), ("b", None), ("c", True)], spark, f"{tmp_path}/kv")
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/kv").collect()] == [("a", "1"), ("b", None), ("c", "1")]
    with pytest.raises(ValueError, match="headers"):
        outputs.merged([rows, rows.select("x", "k", "ok", "n")])
    members = spark.createDataFrame([("g", "t1")], "gorf_id string, torf string")
    with pytest.raises(Exception, match="no genomic ORF"):
        outputs.with_gorf_ids(spark.createDataFrame([("t1",), ("t2",)], "torf_id string"), members).collect()
    gorfs = spark.createDataFrame([("g", "s", "M"), ("g", "z", "M")], "gorf_id string, gorf_signature string, peptide string")
    with pytest.raises(ValueError, match="twice"):
        outputs.write_gorfs(gorfs, members, f"{tmp_path}/x")
    outputs.write_gorfs(gorfs.limit(1), members, f"{tmp_path}/x")
    outputs.clear(spark, f"{tmp_path}/t.tsv")
    assert not (tmp_path / "t.tsv").exists() and F.lit(1) is not None


def test_sequences_in_many_blocks(spark, tmp_path):
    """Lines across the edges of file blocks, of any length, with either kind of line end."""
    rng = random.Random(2)
    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        seqs = {f"c{k}": "".join(rng.choice("acgtN") for _ in range(rng.randint(1, 4000))) for k in range(6)}
        with open(tmp_path / f"{name}.fa", "w", newline="") as file:
            index, at = [], 0
            for chrom, seq in seqs.items():
                text = f">{chrom} text{end}" + "".join(seq[i : i + 61] + end for i in range(0, len(seq), 61))
                index.append(f"{chrom}\t{len(seq)}\t{at + len(chrom) + 6 + len(end)}\t61\t{61 + len(end)}\n")
                file.write(text)
                at += len(text)
        (tmp_path / f"{name}.fa.fai").write_text("".join(index))
        path, whole = str(tmp_path / f"{name}.fa"), {c: s.upper() for c, s in seqs.items()}
        # by byte ranges: the same bases, and little more than their bytes
        found = {}
        for r in sorted(fasta.read_contigs(spark, path, ["c1", "c4", "none"], 100).collect(), key=lambda r: r.piece):
            found[r.chrom] = found.get(r.chrom, "") + r.seq
        assert found == {c: whole[c] for c in ("c1", "c4")}
        wanted = spark.createDataFrame([("c2", -5, 30, 1), ("c2", 60, 62, 2), ("c3", 0, 1 << 40, 3), ("c0", 1 << 40, 1 << 41, 4)], "chrom string, start long, end long, id int")
        assert {r.id: r.seq for r in fasta.read_ranges(spark, path, wanted).collect()} == {k: v for k, v in {1: whole["c2"][:30], 2: whole["c2"][60:62], 3: whole["c3"]}.items() if v}
        assert fasta.byte_ranges(spark, path, wanted.filter("id < 3")).agg(F.sum("n")).first()[0] <= 32 + 2 * len(end)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for size in ("97", "1000", old):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                found = {}
                for r in sorted(fasta.read_fasta(spark, str(tmp_path / f"{name}.fa"), 100).collect(), key=lambda r: r.piece):
                    found[r.chrom] = found.get(r.chrom, "") + r.seq
                assert found == {c: s.upper() for c, s in seqs.items()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)

"""Facts and hand-computed cases of the library's operators."""

import math

import pytest
from codonlake.operators import dm, fdr, intervals, metagene, orfs, psites, reports
from codonlake.sources import formats
from pyspark.sql import functions as F

HOST, TRANS, A0 = (0.1, 0.2, 0.7), (0.8, 0.1, 0.1), 20.0
CODONS = [[2, 1, 7], [1, 1, 8], [2, 0, 8], [1, 2, 7], [2, 1, 7]]


@pytest.fixture(scope="module")
def codons(spark):
    return spark.createDataFrame([(1, i, *c) for i, c in enumerate(CODONS)], "orf long, codon long, c0 long, c1 long, c2 long")


def test_likelihood_and_fit(codons):
    assert dm.loglik(codons, HOST, A0, multinomial=True).first().loglik == pytest.approx(-14.698494, abs=1e-6)
    r = dm.fit_lambda(codons, HOST, TRANS, A0).first()
    assert r.lambda_hat == pytest.approx(0.095574, abs=1e-6) and r.lrt == pytest.approx(1.676969, abs=1e-6)
    assert r.p_asym == pytest.approx(0.097664, abs=1e-6) and r.ci_low == 0 and r.ci_high == pytest.approx(0.285539, abs=1e-6)


def test_fit_at_the_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 9), (2, 0, 30, 0, 0)], "orf long, codon long, c0 long, c1 long, c2 long")
    got = {r.orf: r for r in dm.fit_lambda(df, HOST, TRANS, A0).collect()}
    assert (got[1].lambda_hat, got[1].lrt, got[1].p_asym) == (0.0, 0.0, 1.0) and got[2].lambda_hat == 1.0 and got[2].ci_high == 1.0


def test_contrast_and_expected_reads(spark):
    one = spark.range(1)
    assert one.select(dm.contrast_variance(F.lit(10), 0.1, 0.2, 20.0)).first()[0] == pytest.approx(4.142857, abs=1e-6)
    r = one.select(*dm.expected_reads(F.lit(0.25), F.lit(100), HOST, TRANS)).first()
    assert (r.expected_host, r.expected_trans, r.expected_trans_p0) == (75.0, 25.0, 20.0)


def test_fdr(spark):
    df = spark.createDataFrame([("a", p) for p in (0.001, 0.008, 0.039, 0.041, 0.6)] + [("b", 0.5)], "family string, p double")
    got = {(r.family, r.p): (round(r.q_bh, 6), round(r.q_by, 6)) for r in fdr.adjust(df).collect()}
    assert [got["a", p] for p in (0.001, 0.008, 0.039, 0.041, 0.6)] == [(0.005, 0.011417), (0.02, 0.045667), (0.05125, 0.117021), (0.05125, 0.117021), (0.6, 1.0)]
    assert got["b", 0.5] == (0.5, 0.5)


def test_orf_scan_and_kozak(spark):
    df = spark.createDataFrame([(1, "CCATGAAAATGGCCTAAGATGTTTTGA"), (2, ""), (3, "AT"), (4, "ATGAAANNN")], "tx long, seq string")
    x = orfs.scan(df, min_aa=2).join(df, "tx").withColumn("pep", orfs.translate(F.col("seq"), F.col("t_start"), F.col("t_end")))
    assert sorted((r.tx, r.t_start, r.t_end, r.frame, r.aa_len, r.pep) for r in x.collect()) == [(1, 2, 17, 2, 4, "MKMA"), (1, 18, 27, 0, 2, "MF")]
    assert orfs.scan(df, min_aa=3).count() == 1
    around, strength = orfs.kozak(F.col("seq"), F.lit(2))
    assert tuple(df.filter("tx = 1").select(around, strength).first()) == ("NNNNCCATGAAAAT", "Weak")
    assert df.filter("tx = 4").select(orfs.reverse_complement("seq")).first()[0] == "NNNTTTCAT"


def test_signature(spark):
    s = spark.range(1).select(orfs.signature(F.lit("chr1"), F.lit("+"), F.array(F.lit(30)), F.array(F.lit(101))).alias("s")).select("s", F.sha1("s").alias("h")).first()
    assert s.s == '{"key":["blocks","chr1","+",[30],[101]],"merge_by":"blocks"}' and s.h.startswith("96866a1a58d4cc48")


def test_read_walk(spark):
    cases = [
        (100, 0, "30M", "30", 112, None), (100, 16, "30M", "30", 117, None), (1000, 0, "15M100N15M", "30", 1012, None), (1000, 16, "15M100N15M", "30", 1117, None), (100, 0, "10M2D5M3I12M", "10^AC17", 114, None),
        (100, 16, "10M2D5M3I12M", "10^AC17", None, "skipped_qmap"), (100, 0, "2S28M", "28", None, "skipped_5p_not_aligned"), (100, 0, "30M", "0A29", None, "skipped_5p_mismatch"), (100, 16, "30M", "0A29", 117, None),
        (100, 16, "30M", "29T0", None, "skipped_5p_mismatch"),
    ]
    reads = spark.createDataFrame([(str(i), flag, "c", pos, 60, cigar, md, 1) for i, (pos, flag, cigar, md, _, _) in enumerate(cases)], "qname string, flag int, rname string, pos0 long, mapq int, cigar string, md string, nh int")
    offsets = spark.createDataFrame([(30, 12)], "length int, offset int")
    got = {int(r.qname): (r.psite, r.reason) for r in psites.call(reads, offsets).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4:] for c in cases]
    with pytest.raises(Exception, match="no MD tag"):
        psites.call(reads.limit(1).withColumn("md", F.lit(None).cast("string")), offsets).collect()


def test_offset_selection(spark):
    rows = [(25, 100, 80, 10, 10, 9), (26, 90, 15, 15, 60, 10), (27, 200, 10, 75, 15, 11), (28, 300, 75, 15, 10, 12)]
    got = {r.length: (r.corrected_frame0, r.reason) for r in psites.select_offsets(spark.createDataFrame(rows, "length int, reads long, f0 long, f1 long, f2 long, offset int")).collect()}
    assert got == {25: (80, "outside_dominant_contiguous_block"), 26: (60, "frame0_not_above_threshold"), 27: (75, "selected_quality"), 28: (75, "selected_quality")}


def test_lattice_and_template(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (9, 1, 0)], "c0 long, c1 long, c2 long")
    got = [tuple(r) for r in df.select(*metagene.lattice([F.col(f"c{k}") for k in range(3)])).collect()]
    assert got == [(7, 7, 6), (10, 0, 10), (18, 2, 0)]
    assert metagene.template(df, 1).filter("method = 'read_weighted'").first().pi0 == pytest.approx(11 / 15)


def test_intervals_on_the_minus_strand(spark):
    blocks = spark.createDataFrame([(1, "c", "-", 0, 100, 103), (1, "c", "-", 1, 4095, 4099)], "orf long, chrom string, strand string, block int, start0 long, end0 long")
    sites = spark.createDataFrame([("c", "-", p, 1) for p in (99, 100, 102, 103, 4095, 4096, 4098, 4099)], "chrom string, strand string, pos long, n long")
    got = sorted((r.pos, r.t) for r in intervals.range_join(sites, intervals.with_offsets(blocks)).collect())
    assert got == [(100, 6), (102, 4), (4095, 3), (4096, 2), (4098, 0)]


def test_abundance_and_context(spark):
    rows = spark.createDataFrame([(1, 100, 50, 0.4, 0.2, 0.6, 30), (2, 0, 50, 0.4, 0.2, 0.6, 30), (3, 100, 50, None, 0.2, 0.6, 30)], "id int, n_core_codons int, reads int, lambda double, ci_low double, ci_high double, host_reads int")
    got = {r.id: r for r in reports.quantify(rows, 10**6).collect()}
    assert got[1].pfpkm == pytest.approx(200 / 3) and got[1].pfpkm_low == pytest.approx(100 / 3) and got[1].pfpkm_high == pytest.approx(100) and got[1].host_ratio == pytest.approx(2 / 3)
    assert [got[k].status for k in (2, 3)] == ["invalid_core_length", "not_model_quantifiable"]
    p = reports.path(F.array(F.struct(F.lit(99).alias("start0"), F.lit(102).alias("end0")), F.struct(F.lit(199).alias("start0"), F.lit(202).alias("end0"))), F.lit("-"), F.lit(4))
    assert spark.range(1).select(p).first()[0] == [201, 200, 199, 101]
    assert spark.range(1).select(reports.gcd(F.lit(12), F.lit(18)), reports.gcd(F.lit(0), F.lit(5))).first()[:] == (6, 5)


def test_replicates(spark):
    calls = spark.createDataFrame([("g1", "R1", 0.01, 0.8, 1), ("g1", "R2", 0.02, 0.7, 1), ("g1", "R3", 0.4, 0.1, 0), ("g2", "R1", 0.8, 0.2, 0), ("g2", "R2", 0.03, 0.6, 1)], "key string, replicate string, q double, lambda double, primary int")
    got = {r.key: r for r in reports.integrate(calls, ["R1", "R2", "R3"]).collect()}
    assert (got["g1"].label, got["g1"].n_bh, got["g2"].label) == ("reproducible_primary_credible", 2, "primary_credible_not_reproducible")
    pair = {(r.rep_a, r.rep_b): r for r in reports.pairwise(calls.select("key", "replicate", F.col("lambda").alias("x"))).collect()}["R1", "R2"]
    assert pair.n == 2 and math.isclose(pair.pearson, 1.0) and math.isclose(pair.spearman, 1.0)


def test_formats(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\n\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; gene_type "pc"; tag "basic"; tag "CCDS";\nshort\tline\n')
    r = formats.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert len(r) == 1 and (r[0].start0, r[0].end0, r[0].gene_id, r[0].gene_biotype, r[0].tags) == (10, 20, "g", "pc", ["basic", "CCDS"])
    (tmp_path / "a.sam").write_text("@HD\nq\t16\tchr1\t101\t60\t30M\t*\t0\t0\tACGT\t*\tNH:i:1\tMD:Z:30\n")
    s = formats.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (s.flag, s.pos0, s.md, s.nh) == (16, 100, "30", 1)
    assert formats.length_offsets("28:12, 29:13") == {28: 12, 29: 13} and formats.offset_dict("offdict = {25: 9, 'm0': {25: 9}}") == {25: 9}
    for bad in ("28:28", "28:12 28:13", "0:0"):
        with pytest.raises(ValueError):
            formats.length_offsets(bad)


def test_context_looks_up_positions(spark):
    """No tORF meets a CDS by its gene alone, and pairs are compared in one place of the plan."""
    from codonlake.plans import genome

    plan = genome.cx_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if "Join Inner" in line and "gene_id" in line]
    assert inner and all("pos#" in line or "cds_torf#" in line for line in inner)
    assert plan.count("named_struct(pos") <= 2  # stretches from a codon on


def test_one_cds_of_an_id_stays(spark):
    from codonlake.operators import metagene

    row = ("t1", "CDS", "1", "1", "0", "90", "1", "90", "+", [90], [1])
    names = "torf_id orf_biotype is_annotated_cds has_MANE_Select_tag t_start t_end chromStart1 chromEnd1 strand".split()
    schema = ", ".join(["line long", *[f"{n} string" for n in names], "sizes array<int>", "starts1 array<int>"])
    df = spark.createDataFrame([(5, *row), (5, *row), (4, *row), (9, "t2", *row[1:])], schema)
    got = sorted((r.torf_id, r.line, r.skip or "") for r in metagene.load_cds(df).collect())
    assert got == [("t1", 4, ""), ("t1", 5, "skip_duplicate_torf_id"), ("t1", 5, "skip_duplicate_torf_id"), ("t2", 9, "")]

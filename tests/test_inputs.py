"""Readers and checks of what stages hand to each other, and published fixtures of offsets, context and export."""

import pytest
from codonlake.operators import candidates, context, dm, export, fdr, orfs, psites, replicates, transcripts
from codonlake.sources import formats, inputs, offsets
from pyspark.sql import functions as F

PARA = "x = 1\noffdict = {25: 9, 26: 10, 27: 11, 28: 12, 'm0': {25: 9, 26: 10}}\n"
QUALITY = "\n".join(["{25: 100, 26: 90, 27: 200, 28: 300}", "{}", "{}", "{25: (80, 10, 10), 26: (15, 15, 60), 27: [10, 75, 15], 28: (75, 15, 10)}", "{}"])


def test_offsets_of_the_published_fixture(spark):
    main, other = offsets.parse_offsets(PARA)
    reads, found, *rest = offsets.parse_quality(QUALITY)
    assert main == {25: 9, 26: 10, 27: 11, 28: 12} and other == {25: 9, 26: 10} and rest == [{}, {}]
    support = offsets.support(spark, main, reads, found)
    got = {r.length: r for r in psites.select_offsets(support).collect()}
    assert {n: r.reason for n, r in got.items()} == {25: "outside_dominant_contiguous_block", 26: "frame0_not_above_threshold", 27: "selected_quality", 28: "selected_quality"}
    assert [(got[27].corrected_frame0, got[27].corrected_frame1, got[27].corrected_frame2)] == [(75, 15, 10)] and tuple(got[27].asDict()) == psites.AUDIT
    assert {r.length for r in psites.select_offsets(support, policy="all_passing").filter("selected = 1").collect()} == {25, 27, 28}
    assert {r.length for r in psites.select_offsets(support, whitelist=[28]).filter("selected = 1").collect()} == {28}
    assert inputs.selected_text(psites.override_offsets(support.select("length", "offset"), [26, 28])) == "26:10,28:12"
    assert inputs.selected_text(psites.explicit_offsets(spark, {28: 12, 29: 12})) == "28:12,29:12"
    for bad in ("offdict = {True: 1}", "offdict = {28: -1}", "offdict = [1]", "y = 2", "offdict = {28: 1, 'm0': 3}", "offdict = {"):
        with pytest.raises(ValueError, match=r"\w"):
            offsets.parse_offsets(bad)
    for bad in ("{}", "\n".join(["{28: 1}", "{}", "{}", "{28: (1, 2)}", "{}"]), "\n".join(["{28: 1}", "{}", "{}", "{28: (1, 2, True)}", "{}"])):
        with pytest.raises(ValueError, match=r"\w"):
            offsets.parse_quality(bad)
    for bad in ("28:28", "28:12 28:11", "0:0"):
        with pytest.raises(ValueError, match="bad or repeated"):
            formats.length_offsets(bad)


def test_background():
    good = {"pi0": "0.8", "pi1": "0.1", "pi2": "0.1000001", "A": "12", "pi_method": "codon_equal", "rl_filter": "pooled"}
    pi, a0 = inputs.background(good)
    assert abs(sum(pi) - 1) < 1e-12 and a0 == 12
    for change in ({"pi0": "0"}, {"pi0": "0.9"}, {"A": "0.1"}, {"A": "nan"}, {"A": "x"}, {"pi_method": "trimmed"}, {"rl_filter": "28"}, {"template_status": "failed_low_a0"}):
        with pytest.raises(ValueError, match="background"):
            inputs.background({**good, **change})
    with pytest.raises(ValueError, match="lacks"):
        inputs.background({"pi0": "1"})


def test_tables_of_names_files_and_ids(spark, tmp_path):
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "metric string, value string")
    assert inputs.key_values(kv) == {"a": "1", "b": "2"}
    with pytest.raises(ValueError, match="twice"):
        inputs.key_values(kv.union(kv.limit(1)))
    for n in ("b", "a"):
        (tmp_path / f"s.{n}.torf.tsv").write_text(f"torf_id\tchrom\nt{n}\tchr1\n")
    for spec in (f"{tmp_path}/*.tsv", f"{tmp_path}/", f"{tmp_path}/s"):
        assert [f[-10:] for f in inputs.torf_files(spark, spec)] == ["a.torf.tsv", "b.torf.tsv"]
    assert inputs.read_torfs(spark, f"{tmp_path}/s.a.torf.tsv").count() == 1
    with pytest.raises(ValueError, match="no tORF"):
        inputs.torf_files(spark, f"{tmp_path}/zzz")
    (tmp_path / "list").write_text("# c\n t1 \tx\n\nt2\n")
    (tmp_path / "table").write_text("n\ttorf_id\tgorf_id\n1\tt1\tg1\n2\tt2\t\n")
    assert sorted(r.id for r in inputs.orf_list(spark, f"{tmp_path}/list").collect()) == ["t1", "t2"]
    assert sorted(r.id for r in inputs.orf_list(spark, f"{tmp_path}/table").collect()) == ["g1", "t1", "t2"]
    assert inputs.requested(["a, b", "c"]) == {"a", "b", "c"}
    rows = spark.createDataFrame([("t1", "x"), ("t1", "x"), ("t2", "y"), ("t2", "z")], "torf_id string, v string")
    assert inputs.lookup(rows, rows.filter("torf_id = 't1'")).count() == 1
    for ids in (["t2"], ["t9"]):
        with pytest.raises(ValueError, match=r"unlike|no rows"):
            inputs.lookup(rows, spark.createDataFrame([(i,) for i in ids], "torf_id string"))
    assert inputs.exclusions({"parameters": {"exclude_start_codons": 1, "exclude_stop_codons": 2, "rl": "pooled"}}) == (1, 2, None, "auto")
    assert inputs.library_size(spark.createDataFrame([(0,), (4,), (16,)], "flag int")) == 2


def test_replicates_of_a_batch(spark):
    row = ("R1", "a.bam", "explicit", "28:12", "", "")
    schema = "replicate_id string, bam string, input_mode string, length_offsets string, ribotish_para string, ribotish_quality string"
    read = lambda *rows: inputs.replicates(spark.createDataFrame(list(rows), schema))
    assert [r["replicate_id"] for r in read(row, ("r2", *row[1:]))] == ["R1", "r2"]
    for other in (("r1", *row[1:]), ("R2", "b", "ribotish", "", "p", "q"), ("R 2", *row[1:]), ("R2", "", *row[2:]), ("R2", "b", "explicit", "", "", "")):
        with pytest.raises(ValueError, match=r"\w"):
            read(row, other)


def test_manifests_must_agree():
    base = {**dict.fromkeys(replicates.AGREE, "1"), "parameters": dict.fromkeys(replicates.PARAMETERS, 1), "source": {"caller": {"sha256": "c"}}, "inputs": {"torf_files": [{"exists": True, "sha256": "s", "size_bytes": 1}]}, "output_schema": ["a"]}
    assert len(replicates.PARAMETERS) == 55
    assert replicates.compatible({"R1": base, "R2": base})["caller_sha256"] == "c"
    with pytest.raises(ValueError, match="parameters"):
        replicates.compatible({"R1": base, "R2": {**base, "parameters": {**base["parameters"], "lambda_min": 0.2}}})
    for lost in ("parameters", "source", "inputs", "output_schema", "version"):
        with pytest.raises(ValueError, match="R1"):
            replicates.compatible({"R1": {k: v for k, v in base.items() if k != lost}})
    assert replicates.parse_manifest("{}", "x") == {}
    with pytest.raises(ValueError, match="no object"):
        replicates.parse_manifest("[1]", "x")


def test_results_must_fit_their_manifest(spark):
    rows = spark.createDataFrame([(1, 2)], "a int, b int")
    good = {"output_schema": ["a", "b"], "result_rows": 1, "outputs": [{"path": "x.intorf_dm_results.tsv", "size_bytes": 9, "sha256": "h"}]}
    replicates.fits_manifest(rows, good, 9, "h")
    for bad, args in (({"output_schema": ["a"]}, ()), ({"result_rows": 2}, ()), ({"outputs": []}, ()), ({}, (8, "h")), ({}, (9, "g"))):
        with pytest.raises(ValueError, match=r"\w"):
            replicates.fits_manifest(rows, {**good, **bad}, *args)


def test_loaded_results_are_checked(spark):
    row = ("g1", "F1", fdr.CREDIBLE, "0.01", "0.2", "9")
    schema = "gorf_id string, overlap_type string, classification string, q_BH string, lambda_hat string, core_reads string"
    assert replicates.load(spark.createDataFrame([row], schema), "R1").first().primary_credible_call == "1"
    for bad in ([row, row], [("", *row[1:])]):
        with pytest.raises(Exception, match="candidate"):
            replicates.load(spark.createDataFrame(bad, schema), "R1").collect()
    with pytest.raises(ValueError, match="missing"):
        replicates.load(spark.createDataFrame([("g",)], "gorf_id string"), "R1")


def test_labels_of_replicates(spark):
    rows = [("R1", "g1", "1", ".01"), ("R2", "g1", "1", ".02"), ("R3", "g1", "0", ".4"), ("R1", "g2", "0", ".8"), ("R2", "g2", "1", ".03")]
    x = None
    for r in ("R1", "R2", "R3"):
        one = spark.createDataFrame([(g, "F1", "c", q, "0.1", "5", p) for n, g, p, q in rows if n == r], "gorf_id string, overlap_type string, classification string, q_BH string, lambda_hat string, core_reads string, primary_credible_call string")
        one = replicates.load(one, r)
        x = one if x is None else x.unionByName(one)
    got = {r.candidate_key: r for r in replicates.integrate(x, ["R1", "R2", "R3", "Gone"], ["R1", "R2", "R3"]).collect()}
    assert got["g1|F1"].consensus_classification == "reproducible_primary_credible" and got["g1|F1"].n_bh_significant == 2 and got["g1|F1"]["replicate::Gone::present"] == 0
    assert got["g2|F1"].consensus_classification == "primary_credible_not_reproducible" and got["g2|F1"].n_replicates_observed == 2
    alone = replicates.integrate(x.filter("replicate_id = 'R1'"), ["R1", "R2"], ["R1"]).collect()
    assert {r.consensus_classification for r in alone} == {"single_replicate_primary_credible", "not_primary_credible"}


def test_context_on_the_minus_strand(spark):
    rows = [("t", "g", "G", "T1", "n", "", "chr1", "-", False, [100, 200], [105, 205], "MAAA"), ("c", "", "G", "T2", "n", "CCDS", "chr1", "-", True, [100, 200], [105, 205], "MAAA")]
    x = spark.createDataFrame(rows, "torf_id string, gorf_id string, gene_id string, transcript_id string, transcript_name string, tx_tags string, chrom string, strand string, is_annotated_cds boolean, s array<long>, e array<long>, peptide string")
    x = x.withColumn("path", context.translation_path(F.col("s"), F.col("e"), F.col("strand"), F.length("peptide").cast("long")))
    assert x.first().path == [*range(205, 199, -1), *range(105, 99, -1)]
    got = context.context(spark.createDataFrame([("g", "G")], "gorf_id string, gene_id string"), x, 4).first()
    assert got.gene_cds_nterm_coordinate_prefix_nt == 12 and got.gene_level_orf_class == "annotated_cds_derived_full_coordinate_path" and got.gene_level_pure_intorf_eligible == 0
    for bad in ("array(5L)", "array(5L, 7L)"):
        with pytest.raises(Exception, match="block"):
            spark.range(1).select(context.translation_path(F.expr("array(1L, 9L)"), F.expr(bad), F.lit("+"), F.lit(1).cast("long"))).collect()


def test_export_of_the_published_fixture(spark):
    codons = spark.createDataFrame([("k", 0, 9, 1, 0, 0), ("k", 1, 9, 3, 0, 0), ("k", 2, 9, 1, 1, 0), ("k", 3, 9, 0, 0, 2)], "candidate_key string, codon long, n long, c0 long, c1 long, c2 long").select("candidate_key", "codon", F.lit(5).cast("long").alias("n_codons"), "c0", "c1", "c2")
    core = export.core(codons, 1, 1)
    s = export.summaries(core).first()
    assert (s.n_core_codons, s.core_reads, s.codon_equal_mean_P0_percent) == (3, 7, 50.0) and abs(s.codon_equal_mean_P2_percent - 100 / 3) < 1e-9
    assert sorted((r.phase_ratio_P0, r.phase_ratio_P1, r.phase_ratio_P2) for r in export.ternary_rows(core).collect()) == [(0, 0, 1), (1, 0, 0), (1, 1, 0)]
    t = export.totals(core).first()
    assert (t.observed_phase0_core_reads, t.observed_phase1_core_reads, t.observed_phase2_core_reads) == (4, 1, 2)
    with pytest.raises(ValueError, match="differ"):
        export.checked(export.reconciled(spark.createDataFrame([("k", "8")], "candidate_key string, core_reads string"), core))
    rows = spark.createDataFrame([("g1", "F1", "t1", "0", "1"), ("g2", "F1", "t2", "1", "0"), ("", "F1", "t3", "1", "1")], "gorf_id string, overlap_type string, torf_id string, primary_credible_call string, gene_level_pure_intorf_eligible string")
    assert [r.candidate_key for r in export.selected(rows, pure_only=True).collect()] == ["t3"]
    wanted = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(r.candidate_key for r in export.selected(rows, wanted("g1", "t2")).collect()) == ["g1|F1", "g2|F1"]
    with pytest.raises(ValueError, match="no rows for"):
        export.selected(rows, wanted("g1", "zzz"))
    with pytest.raises(ValueError, match="two rows"):
        export.selected(rows.union(rows), selection="all")


def test_flags_and_values_that_stop_a_job(spark):
    row = ("intORF_altframe", 0, 0, [30], [1], 0, 1, 1)
    schema = "orf_biotype string, is_annotated_cds int, mane int, sizes array<int>, starts1 array<int>, same_gene int, any_gene int, confounded int"
    assert candidates.eligible(spark.createDataFrame([row], schema)).first().use == "candidate"
    for flags in ((2, 1, 1), (1, 0, 0), (0, 1, 0)):
        with pytest.raises(Exception, match=r"flag|gene"):
            candidates.eligible(spark.createDataFrame([(*row[:5], *flags)], schema)).collect()
    reads = lambda lam, n: spark.range(1).select(*dm.expected_reads(F.lit(lam), F.lit(n), (0.1, 0.2, 0.7), (0.8, 0.1, 0.1))).first()
    got = reads(0.25, 100.0)
    assert (got.expected_host, got.expected_trans) == (75.0, 25.0) and abs(got.expected_trans_p0 - 20) < 1e-9
    for lam, n in ((1.5, 1.0), (-0.1, 1.0), (0.5, -1.0), (float("nan"), 1.0)):
        with pytest.raises(Exception, match="must be"):
            reads(lam, n)
    with pytest.raises(ValueError, match="template"):
        dm.expected_reads(F.lit(0.1), F.lit(1.0), (0, 0, 0), (1, 0, 0))
    assert dm.separated((0.1, 0.2, 0.7), (0.8, 0.1, 0.1), 2) and not dm.separated((0.34, 0.33, 0.33), (0.33, 0.33, 0.34), 2)


def test_read_lengths(spark):
    sites = spark.createDataFrame([(28, 1), (None, 29), (30, 1)], "RL int, query_length int")
    assert psites.of_length(sites, None).count() == 3 and psites.of_length(sites, 29).count() == 1 and psites.of_length(sites, 1, "query_length").count() == 2
    psites.check_length(sites, 28)
    for bad, source in ((40, "auto"), (0, "auto")):
        with pytest.raises(ValueError, match="read length"):
            psites.check_length(sites, bad, source)


def test_adjustment_of_a_family(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.6]
    rows = spark.createDataFrame([("f", x) for x in p] + [("one", 1.0), (None, 0.5), (None, None)], "family string, p double")
    got = sorted((r.p, round(r.q_bh, 6), round(r.q_by, 6)) for r in fdr.adjust(rows).filter("family = 'f'").collect())
    assert [q for _, q, _ in got] == [0.005, 0.02, 0.05125, 0.05125, 0.6] and [q for *_, q in got] == [0.011417, 0.045667, 0.117021, 0.117021, 1.0]
    assert fdr.adjust(rows).count() == len(p) + 3
    sums = spark.range(1, 400).select("id", fdr.harmonic(F.col("id")).alias("h")).collect()
    assert all(abs(r.h - sum(1 / k for k in range(1, r.id + 1))) < 1e-12 for r in sums)


def test_tail_of_chi_square(spark):
    import math

    x = [0.0, 1e-16, 1e-9, 0.01, 1.676969, 3.9, 7.9, 8.0, 8.1, 30.0, 200.0, 1000.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "x double").select(dm.half_chi2_tail(F.col("x")).alias("p")).collect()]
    want = [1.0 if v <= 1e-14 else 0.5 * math.erfc(math.sqrt(v / 2)) for v in x]
    assert all(abs(a - b) <= 1e-11 * b for a, b in zip(got, want, strict=True))


def test_ranges_over_bin_edges(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 12, 31), ("a", 31, 40), ("a", 50, 50), ("b", 3, 47), ("b", 60, 61), ("a", 70, 80), ("a", 79, 95)]
    got = sorted(map(tuple, orfs.merge_ranges(spark.createDataFrame(rows, "k string, start0 long, end0 long"), "k", 10).collect()))
    assert got == [("a", 0, 9), ("a", 12, 40), ("a", 70, 95), ("b", 3, 47), ("b", 60, 61)]
    sites = spark.createDataFrame([("c", "+", p, n) for p, n in [(8, 2), (9, 2), (10, 2), (11, 1), (20, 1), (30, 5), (31, 5), (39, 5), (40, 5)]], "chrom string, strand string, pos long, n long")
    runs = sorted((r.start0, r.end0, r.depth) for r in psites.bedgraph(sites, 10).collect())
    assert runs == [(8, 11, 2), (11, 12, 1), (20, 21, 1), (30, 32, 5), (39, 41, 5)]


def test_contigs_genes_and_stops(spark):
    names = ["chr1", "MT", "chr1_alt", "chr2_fix", "chrUn_1", "x_unlocalized", "weird", "chr23"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(orfs.contig_class(F.col("n")).alias("c")).collect()]
    assert got == ["primary", "primary", "alt", "patch", "alt", "alt", "other", "other"]
    rows = [(0, "gene", "G", None, "name", "kind"), (1, "exon", "G", "T", "late", "late"), (2, "exon", "H", "U", "other", None)]
    gtf = spark.createDataFrame([("chr1", f, 0, 9, "+", g, t, n, None, k, None, [], line) for line, f, g, t, n, k in rows], "chrom string, feature string, start0 int, end0 int, strand string, gene_id string, transcript_id string, gene_name string, transcript_name string, gene_biotype string, transcript_biotype string, tags array<string>, line long")
    assert {r.gene_id: (r.gene_name, r.gene_biotype) for r in transcripts.genes(gtf).collect()} == {"G": ("name", "kind"), "H": ("other", "")}
    assert {r.transcript_id: r.gene_name for r in transcripts.indexed(gtf).collect()} == {"T": "name", "U": "other"}

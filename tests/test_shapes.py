"""Context of many candidates and CDSs of one path."""

import time

from codonlake.operators import context
from pyspark.sql import functions as F


def test_paths_that_are_alike_are_compared_once(spark):
    """4,000 candidates and 800 CDSs of one path: 3.2 million pairs one by one. All transcripts of the path tie."""
    path = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i.cast("long"))
    made = lambda n, kind, cds: spark.range(n).select(
        F.concat(F.lit(kind), F.col("id").cast("string")).alias("torf_id"), (F.lit("") if cds else F.concat(F.lit("g"), F.col("id").cast("string"))).alias("gorf_id"), F.lit("G").alias("gene_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("transcript_id"),
        F.lit("n").alias("transcript_name"), F.when(F.col("id") == 700, "MANE_Select").otherwise("CCDS").alias("tx_tags"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), F.lit(cds).alias("is_annotated_cds"), path.alias("path"), F.lit("MAAAAAAAAA").alias("peptide"),
    )
    torfs = made(4000, "t", False).unionByName(made(800, "c", True))
    began = time.time()
    rows = context.context(torfs.filter("not is_annotated_cds").select("gorf_id", "gene_id"), torfs).collect()
    assert time.time() - began < 60 and len(rows) == 4000
    tied = ",".join(sorted(f"T{k}" for k in range(800)))
    for r in rows:
        assert (r.gene_cds_nterm_best_transcript_id, r.gene_cds_nterm_best_transcript_tags, r.gene_cds_nterm_tied_transcript_ids) == ("T700", "MANE_Select", tied)
        assert (r.gene_cds_nterm_coordinate_prefix_nt, r.gene_cds_nterm_candidate_torf_id) == (30, "t" + r.gorf_id[1:])


def test_transcripts_of_all_shapes_of_a_candidate_tie(spark):
    """Two tORFs of a candidate that meet CDSs of unlike paths equally well: both transcripts are named."""
    path = lambda a: list(range(a, a + 30))
    row = lambda t, g, tx, cds, a: (t, g, "G", tx, "n", "CCDS", "chr1", "+", cds, path(a), "MAAAAAAAAA")
    rows = [row("t1", "g", "X1", False, 1), row("t2", "g", "X2", False, 101), row("c1", "", "T2", True, 1), row("c2", "", "T1", True, 101), row("c3", "", "T3", True, 101)]
    x = spark.createDataFrame(rows, "torf_id string, gorf_id string, gene_id string, transcript_id string, transcript_name string, tx_tags string, chrom string, strand string, is_annotated_cds boolean, path array<long>, peptide string")
    r = context.context(spark.createDataFrame([("g", "G")], "gorf_id string, gene_id string"), x).first()
    assert (r.gene_cds_nterm_tied_transcript_ids, r.gene_cds_nterm_best_transcript_id, r.gene_cds_nterm_candidate_torf_id) == ("T1,T2,T3", "T1", "t2")


def test_names_of_transcripts_are_in_no_shuffle_of_candidates(spark):
    """The join that brings the tied transcripts comes last, and columns of any names go through it."""
    path = lambda a: list(range(a, a + 30))
    row = lambda t, g, tx, cds, a: (t, g, "G", tx, "n", "CCDS", "chr1", "+", cds, path(a) if a else [], "MAAAAAAAAA")
    rows = [row("t1", "g", "X1", False, 1), row("t2", "g", "X2", False, 1), row("t3", "h", "X3", False, 500), row("t0", "h", "X4", False, 0), row("c1", "", "T2", True, 1), row("c2", "", "T1", True, 1)]
    x = spark.createDataFrame(rows, "torf_id string, gorf_id string, gene_id string, transcript_id string, transcript_name string, tx_tags string, chrom string, strand string, is_annotated_cds boolean, path array<long>, peptide string")
    asked = spark.createDataFrame([("g", "G", 1, "a"), ("g", "G", 2, "b"), ("h", "G", 3, "c"), ("i", "G", 4, "d"), ("g", None, 5, "e")], "gorf_id string, gene_id string, shape int, torf_id string")
    out = context.context(asked, x)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "_profile" in joins[0] and "gorf_id" not in joins[0]
    got = {r.shape: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[2].torf_id == "b" and out.columns[:4] == asked.columns
    told = lambda r: (r.gene_cds_nterm_candidate_torf_id, r.gene_cds_nterm_tied_transcript_ids, r.gene_cds_nterm_coordinate_prefix_nt, r.gene_cds_nterm_break_reason)
    assert told(got[1]) == told(got[2]) == ("t1", "T1,T2", 30, context.WHOLE)
    assert told(got[3]) == ("t0", "", 0, context.NO_PREFIX) and told(got[4]) == ("", "", 0, context.ABSENT) and told(got[5]) == (None,) * 4

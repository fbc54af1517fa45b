"""Transcript models, coordinate maps and candidates: hand-made cases."""

import pytest
from codonlake.operators import candidates, transcripts
from codonlake.sources import formats
from pyspark.sql import functions as F

GTF = """# comment
c1\tx\texon\t11\t20\t.\t-\t.\tgene_id "g"; transcript_id "t"; tag "B"; tag "A"; gene_name "G";
c1\tx\texon\t31\t40\t.\t-\t.\tgene_id "g"; transcript_id "t"; tag "A";
c1\tx\tCDS\t15\t36\t.\t-\t.\tgene_id "g"; transcript_id "t";
c1\tx\tstart_codon\t34\t36\t.\t-\t.\tgene_id "g"; transcript_id "t";
c1\tx\tCDS\t5\t9\t.\t+\t.\tgene_id "h"; transcript_id "u";
"""


def test_gtf_to_models_and_maps(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    gtf = formats.read_gtf(spark, str(tmp_path / "a.gtf")).withColumn("line", F.monotonically_increasing_id())
    x = transcripts.models(gtf)
    r = x.first()
    assert x.count() == 1 and r.transcript_id == "t" and r.tags == ["A", "B"] and r.gene_name == "G"
    assert [tuple(i) for i in r.exons] == [(10, 20), (30, 40)]
    x = x.withColumn("at", transcripts.placed(F.col("exons"), F.col("strand")))
    one = x.select("at", transcripts.to_transcript(F.col("cds"), F.col("at"), F.col("strand")).alias("cds"), transcripts.to_transcript(F.col("start_codon"), F.col("at"), F.col("strand")).alias("start"),
                   transcripts.lift(F.col("at"), F.col("strand"), F.lit(4).cast("long"), F.lit(16).cast("long")).alias("back")).first()
    assert [tuple(i) for i in one["at"]] == [(30, 40, 0), (10, 20, 10)]
    assert [tuple(i) for i in one.cds] == [(4, 16)] and [tuple(i) for i in one.start] == [(4, 7)]
    assert [tuple(i) for i in one.back] == [(14, 20), (30, 36)]


def test_union(spark):
    x = spark.sql("SELECT array(named_struct('s', 5L, 'e', 9L), named_struct('s', 1L, 'e', 5L), named_struct('s', 11L, 'e', 12L)) AS i")
    assert [tuple(p) for p in x.select(transcripts.union(F.col("i")).alias("u")).first().u] == [(1, 9), (11, 12)]
    assert x.select(transcripts.union(transcripts.none()).alias("u")).first().u == []


def test_model_without_cds_uses_the_first_stop(spark):
    none = transcripts.none()
    start = F.array(F.struct(F.lit(2).cast("long").alias("s"), F.lit(5).cast("long").alias("e")))
    x = spark.createDataFrame([("CCATGAAATAACC",), ("CCATGAAACCC",)], "seq string").select("seq", none.alias("cds"), start.alias("start_codon"), none.alias("stop_codon"))
    got = {r.seq: r for r in transcripts.with_model(x).collect()}
    a, b = got["CCATGAAATAACC"], got["CCATGAAACCC"]
    assert (a.tx_model, a.ann_start, a.ann_end, a.tx_complete_cds, a.tx_cds_synthesized) == ("coding", 2, 11, 1, 1)
    assert (b.tx_model, b.ann_end, b.cds_last_t, b.tx_complete_cds) == ("no_stop", None, 11, 0)


def test_overlap_types_and_templates(spark):
    assert candidates.host_template("F1", (0.7, 0.2, 0.1)) == (0.2, 0.1, 0.7) and candidates.host_template("F2", (0.7, 0.2, 0.1)) == (0.1, 0.7, 0.2)
    x = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (1, 2)], "a int, b int")
    assert [r[0] for r in x.select(candidates.overlap_type(F.col("a"), F.col("b"))).collect()] == ["F1", "F2", None, "F2"]
    with pytest.raises(ValueError):
        candidates.grouped(x, "other")

"""Every operator and stage on tables with clashing names, nulls in any column, long texts, repeats and no rows."""

import corpus_pipeline
import pytest
from codonlake.llm import fingerprints, html_text, language, line_dedup, mixing, ngram_join, pieces, topk, toxicity, url_filter
from pyspark.sql import functions as F

#: Names that operators use inside, or used to.
INNER = """_score _spans toxicity toxicity_ _lines _gone n_lines n_deleted gone lost lines tag key _id id n node label centre part parts component_id
_block _slot _position _release _deadline block slot position release deadline at h s b nb row _row text_ cell rn from listed _h1 _h2 h1 h2 shard c0 n0 c1
_t _i _y word doc rows sig posted""".split()
LONG = "mi lo ka tu " * 60_000


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"lo mi tu {'zzbad' if i % 3 == 0 else 'ka'} mi lo ka tu {'o' * (i % 7 + 1)}\nw{i} x{i} y{i} z{i}", "en", "big" if i % 2 else None, i) for i in range(60)]
    rows += [(100, LONG, "en", "s", 1), (101, LONG, None, "s", None), (102, None, None, None, None), (103, "", "en", "s", 0), (None, "no id", "en", "s", 5), (104, " \n\t", "en", "s", 3)]
    rows += [rows[5], rows[5], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 7).alias(c) for c in INNER]
    docs = docs.select("*", *extra, F.create_map(F.lit("k"), "doc_id").alias("map"), F.lit(2**62 + 1).alias("large")).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (103, 1, None)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels


def same(before, after, keep=lambda r: True, less=()):
    """Whether the rows that stay are those of before, all columns alike but for `less`."""
    plain = lambda df: sorted((str(tuple(v for c, v in zip(df.columns, r) if c not in less)) for r in df.collect()), key=str)
    return after.columns == before.columns and after.dtypes == before.dtypes and plain(after) == plain(before.filter(keep))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tables, tmp_path, name):
    docs, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    if name == "sentencepiece":
        got = out.collect()
        assert len(got) == docs.count() == len({r.position for r in got}) and all(r.round_trip for r in got)
        assert {r.n_tokens for r in got if r.doc_id == 103} == {0} and next(r.n_tokens for r in got if r.doc_id == 100) > 60_000
    elif name == "mixing":
        assert same(docs, out, F.lit(True))
    elif name == "line_dedup":
        assert same(docs, out, F.lit(True), ("text", "n_chars"))
        assert {r.doc_id: r.text for r in out.collect()}[101] == ""
    elif name == "ngram_join":
        got = [r.doc_id for r in out.collect()]
        assert got.count(5) == 1 and got.count(None) == 2 and {102, 103, 104, 100} <= set(got) and 101 not in got and out.dtypes == docs.dtypes
        assert {r.large for r in out.collect()} == {2**62 + 1}
    else:
        assert out.dtypes == docs.dtypes and {102, 103, 104} <= {r.doc_id for r in out.collect()} and {r.large for r in out.collect()} == {2**62 + 1}
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0


def test_operators(spark, tables):
    docs, labels = tables
    n = docs.count()
    assert toxicity.scored(docs, labels, score_col="x_score", spans_col="x_spans").select("doc_id", "x_score", "x_spans").count() == n
    assert language.predict(docs, docs).count() == language.report(docs).count() == n
    assert line_dedup.with_deletions(docs, lines_col="x", gone_col="y").count() == n
    assert fingerprints.fingerprint_report(docs).count() == n
    groups = ngram_join.near_groups(docs).collect()
    assert len(groups) == n and {r.component_id for r in groups if r.id == 101} == {100}
    assert pieces.detokenised(pieces.tokenised(docs, names=("x", "y", "z")), "x", name="back").filter("back <> coalesce(text, '')").count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), "text").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), *INNER)
    assert html_text.extracted(pages, fit_pages=60).count() == url_filter.judge(pages).count() == n
    assert html_text.extracted(pages.limit(0), fit_pages=60).count() == url_filter.judge(pages.limit(0)).count() == 0
    keyed = docs.withColumn("want", F.col("doc_id") % 3 == 0)
    found = url_filter.with_membership(keyed, "text", url_filter.cascades(keyed.withColumn("want", F.coalesce("want", F.lit(False))), "text", "want"))
    assert found.count() == n and found.columns == [*keyed.columns, "listed_"]
    vectors = topk.quantised(spark.createDataFrame([(i, [float(i % 5 - 2), None if i == 7 else 1.0], i) for i in range(40)] + [(None, [1.0], 1)], "vec_id long, embedding array<double>, id2 int"), "vec_id", "embedding")
    assert topk.top_k(vectors.withColumn("score", F.lit(1)), vectors.filter("id < 3"), 4, block=2, pass_bytes=100).count() == 12
    for out, new in ((toxicity.scored(docs, labels), ["toxicity__"]), (line_dedup.with_deletions(docs), ["n_lines_", "n_deleted_"]), (mixing.schedule(docs), ["block_", "slot_", "release_", "deadline_", "position_"])):
        assert out.columns == [*docs.columns, *new] and out.count() == n


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from codonlake.llm import shared

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.folder(Session)
    Session.sparkContext.master = "local[4]"
    assert shared.folder(Session).startswith("file:")


def test_hot_keys_are_dealt_to_parts(spark, monkeypatch):
    from codonlake.functions import skew

    monkeypatch.setattr(skew, "small", lambda df: False)
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).when(F.col("id") < 2900, F.col("id")).otherwise(None).cast("long").alias("key"))
    lookup = spark.range(2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    for how in ("left", "inner"):
        got = skew.join_unique(rows, lookup, "key", "id", how)
        want = rows.join(lookup, "key", how)
        assert sorted(map(tuple, got.select("id", "key", "value").collect()), key=str) == sorted(map(tuple, want.select("id", "key", "value").collect()), key=str)

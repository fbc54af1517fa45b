"""The pipeline's stages and the registered queries."""

import random

import __spark_entry__
import corpus_pipeline
import pytest
from codonlake.llm import line_dedup, mixing, pieces, registry
from test_basic import brute_schedule
from test_pairs import brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            w[3] = w[9] = "vileword"
        docs.append([i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), "en", "big" if i % 3 else f"s{i % 4}", 0])
        labels.append((i, 1, int(i % 6 == 0)))
    near = docs[7][1].replace("\n", " ").split()
    near[-1] = "changed"
    docs.append([1000, " ".join(near), "en", "big", 0])  # near copy, on one line
    docs.append([1001, docs[8][1], "en", None, 0])  # exact copy
    docs.append([1002, None, None, None, None])
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = spark.createDataFrame(docs.collect(), docs.schema)
        docs = seen[name]
        assert docs.columns == columns or name == "sentencepiece"
    ids = {k: {r.doc_id for r in v.collect()} for k, v in seen.items()}
    toxic = set(range(0, 300, 6))
    assert not ids["toxicity"] & toxic and len(ids["toxicity"]) >= 250
    assert ids["line_dedup"] == ids["toxicity"]
    assert {r.doc_id: r.text for r in seen["line_dedup"].collect()}[1001] == ""
    assert ids["line_dedup"] - ids["ngram_join"] == {1000}
    assert ids["mixing"] == ids["ngram_join"] == ids["sentencepiece"]
    assert all(r.round_trip for r in seen["sentencepiece"].collect())
    assert corpus_pipeline.run(spark, folder).count() == len(ids["mixing"])


def test_run_keeps_the_order_of_the_mix(spark, folder, tmp_path):
    corpus_pipeline.run(spark, folder).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.position for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mix = mixing.mixed(docs.filter(docs.doc_id.isin([r.doc_id for r in rows]))).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == [r.doc_id for r in mix]


def test_run_matches_brute_force(spark, folder):
    """Everything after the trained stage again, plainly: alignment with every earlier document, all pairs of shingle sets, the schedule of blocks."""
    clean = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()), key=lambda r: r[0])
    texts, lines = {}, {i: None if t is None else t.split("\n") for i, t, _ in clean}
    for i, text, _ in clean:
        if text is None:
            texts[i] = None
            continue
        words = [len(x.split()) for x in lines[i]]
        gone = {k for e in lines if e < i and lines[e] for k in line_dedup.common_lines([hash(x.strip()) for x in lines[e]], [hash(x.strip()) for x in lines[i]], words)}
        texts[i] = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
    ids = list(texts)
    groups, _ = brute_groups([texts[i] for i in ids], 5, 80)
    left = [i for k, i in enumerate(ids) if groups[k] == k]
    source = {i: s for i, _, s in clean}
    out = corpus_pipeline.run(spark, folder)
    rows = pieces.detokenised(out, "token_ids", name="back").collect()
    assert {r.doc_id: r.back for r in rows} == {i: texts[i] or "" for i in left} and len(rows) == len(left)
    counts = {s: sum(source[i] == s for i in left) for s in {source[i] for i in left}}
    names = sorted(counts, key=lambda s: "null" if s is None else f"s:{s}")
    schedule = brute_schedule([-(-counts[s] // mixing.BLOCK_DOCS) for s in names], [counts[s] ** 0.5 for s in names])
    order = [names[k] for k, *_ in schedule]
    got = {}
    for r in rows:
        got.setdefault(r.position // mixing.BLOCK_DOCS, set()).add(r.source)
    assert [got[k] for k in sorted(got)] == [{s} for s in order]


def test_registry():
    names = registry.queries()
    assert "pipeline" in __spark_entry__.queries() and set(names) < set(__spark_entry__.queries()) and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))

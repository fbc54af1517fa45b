"""The quality classifier against a plain version, and on tables with nulls, repeats and odd names."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from codonlake.llm import quality
from pyspark.sql import functions as F

SYLLABLES = ["ka", "lo", "mi", "tu", "re", "no", "ische", "ü"]


def text(rng, low):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
    if low:
        way = rng.randrange(3)
        words = [w.upper() + "!!" for w in words] if way == 0 else [w for w in words[:6] for _ in range(6)] if way == 1 else [w + rng.choice(["###", "***"]) for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, text(rng, i % 4 == 0), int(i % 4 != 0)) for i in range(600)]


def test_shares_of_n_grams():
    texts = ["Ab, ab ab, x", "", " \n", "A"]
    slots = {d: {} for d in range(4)}
    for family in quality.features(texts):
        docs, found = family
        for d, s in zip(docs.tolist(), found.tolist(), strict=True):
            slots[d].setdefault(s, 0)
    assert not slots[1] and not slots[2]
    by = quality.vectors(texts)
    assert [len(s) for s, _ in by] == [len(slots[d]) + 1 for d in range(4)] and all(s[-1] == 1 << quality.BITS and v[-1] == 1 for s, v in by)
    assert math.isclose(by[0][1].sum(), 1 + 5 * quality.SCALE) and math.isclose(by[3][1].sum(), 1 + 2 * quality.SCALE)
    # words and pairs don't see case; shapes do
    a, b = ({tuple(x) for x in np.stack(quality.features([t])[k]).T.tolist()} for t, k in (("Mi lo", 1), ("mi LO", 1)))
    assert a == b and quality.features(["Mi lo"])[2][1].tolist() != quality.features(["mi LO"])[2][1].tolist()


def plain_train(sample, epochs, seed=7):
    """One weight at a time, as the update is defined."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else (math.copysign(quality.L1, zi) - zi) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(sample)):
            y, slots, values = sample[k]
            w = [weight(i) for i in slots.tolist()]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * v for a, v in zip(w, values, strict=True))))))
            for i, v, wi in zip(slots.tolist(), values.tolist(), w, strict=True):
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * wi
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_updates_and_scores_match_a_plain_version(rows):
    texts = [t for _, t, _ in rows[:80]] + ["", "lo " * 5000]
    found = quality.vectors(texts)
    sample = [(y, s, v) for (_, _, y), (s, v) in zip(rows[:80], found, strict=False)]
    weights = quality.train(sample, epochs=2)
    plain = plain_train(sample, 2)
    assert all(abs(weights[i] - plain(i)) < 1e-4 for i in {i for _, s, _ in sample for i in s.tolist()})
    dots = [float(weights[s].astype(float) @ v) for s, v in found]
    assert np.allclose(quality.score(texts, weights), [1 / (1 + math.exp(-d)) for d in dots], atol=1e-5)
    assert quality.train([(1, *found[0])]) is None and quality.train([]) is None and (quality.score(["a"], None) == 0.5).all()


def test_held_out_quality(spark, rows):
    extra = [(1000, None, 1), (1001, "", 1), (1002, "mi lo ka. " * 30_000, 1), (None, "mi lo", 1)]
    docs = spark.createDataFrame([r[:2] for r in [*rows, *extra, rows[7]]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (1001, None)], "doc_id long, quality int")
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.predicted for r in got if r.doc_id == 1002} == {1} and len({r.score for r in got if r.doc_id == 7}) == 1
    # labels of held-out rows change nothing
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality.report(docs, other).collect())) == sorted(map(str, got))
    assert quality.report(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.report(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    named = docs.select("doc_id", "text", F.lit(1).alias("quality"), F.lit("x").alias("_t"), F.lit(2).alias("slots"), F.lit(3).alias("_y"))
    out = quality.scored(named, labels, low=50, other=50)
    assert out.columns == [*named.columns, "quality_"] and out.count() == docs.count()
    assert re.match("[0-9.]+", str(out.first()["quality_"]))

"""Mined phrases against counting every n-gram, on tables with nulls, repeats, long texts and odd names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from codonlake.llm import phrases, shared
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most, percent, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = [p for p, n in f.items() if len(p) > 1 and n >= least]
        longest = {}
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    part = p[i : i + k]
                    longest[part] = max(longest.get(part, 0), f[p])
        rows = []
        for p in found:
            if 100 * longest.get(p, 0) >= percent * f[p]:
                continue
            a, n = f[p], totals[lang]
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r, n))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -score) for k, (score, a, p, l, r, n) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["ka", "Lo", "mi", "tu", "éa", "ÉA", "zo x", "a-b", "x", "y"]
    fixed = ["the old ka tu mi", "lo mi lo mi lo mi", "one two three four five six seven"]
    out = []
    for i in range(160):
        parts = [rng.choice(fixed) if rng.random() < 0.25 else rng.choices(words, range(10, 0, -1))[0] for _ in range(rng.randint(1, 30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t ", " ", ". ", ",", "\n", " \r\n"]) for p in parts)
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return [*out, ("en", None), ("en", ""), ("de", " .,\n"), (None, None), ("fr", "lo mi " * 20_000), out[0], out[0]]


def test_phrases_match_counting(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    named = docs.select("*", F.lit(1).alias("f"), F.lit("x").alias("phrase"), F.lit(2).alias("names"), F.lit(None).cast("int").alias("left"))
    for least, most, percent, top in ((5, 5, 100, 2000), (3, 4, 70, 25)):
        got = sorted(tuple(r) for r in phrases.mined(named, least=least, most_words=most, percent=percent, top=top).collect())
        assert got == plain(rows, least, most, percent, top) and len(got) > 40
    assert phrases.mined(docs.limit(0)).count() == 0 and phrases.mined(docs.filter("text is null")).count() == 0


def test_names_point_to_parents(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    scratch = shared.Scratch(spark)
    totals, levels = phrases.names(scratch, docs, least=5)
    assert {r.lang for r in totals.collect()} == {"en", "de", "und", "fr"}
    held = [{(r.lang, r.id): r for r in level.collect()} for level in levels]
    for below, level in zip(held, held[1:], strict=False):
        assert level
        for (lang, _), r in level.items():
            first, rest = below[lang, r.left], below[lang, r.right]
            assert r.phrase.split(" ")[:-1] == first.phrase.split(" ") and r.phrase.split(" ")[1:] == rest.phrase.split(" ")
            assert r.firsts == [*first.firsts, r.f] and r.lasts == [*rest.lasts, r.f]


def test_small_holds_and_shared_hashes(spark, rows, monkeypatch):
    """Tasks that hand on early, and words whose hashes meet, give the same phrases."""
    tokens, batch = phrases._Tokens, [rows[0][1], rows[1][1]]
    t = tokens(batch, 0)
    found, first, code = np.unique(t.hash, return_index=True, return_inverse=True)
    assert phrases._alike(t, first, code)
    wrong = code.copy()
    wrong[0] = (code[0] + 1) % len(found)
    assert not phrases._alike(t, first, wrong)
    assert set(tokens(batch, 0).hash.tolist()).isdisjoint(tokens(batch, 1).hash.tolist())
    merged = phrases._merged([(np.array([3, 1, 3], np.uint64), np.array([1, 3, 1], np.uint64), np.array([1, 2, 4]))])
    assert [x.tolist() for x in merged] == [[1, 3], [3, 1], [2, 5]]
    docs = spark.createDataFrame(rows[:40], "lang string, text string").coalesce(1)
    want = sorted(tuple(r) for r in phrases.mined(docs, least=4).collect())
    monkeypatch.setattr(phrases, "HELD", 3)
    assert sorted(tuple(r) for r in phrases.mined(docs, least=4).collect()) == want == plain(rows[:40], 4, 5, 100, 2000)

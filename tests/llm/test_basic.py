"""Top-k search, URL filters, mixing and fingerprints against brute force."""

import hashlib
import random
import struct
from fractions import Fraction
from itertools import islice
from math import ceil, floor

import numpy as np
import xxhash
from codonlake.llm import fingerprints, mixing, topk, url_filter
from pyspark.sql import functions as F

NAN = float("nan")


def test_top_k_matches_brute_force_with_ties_nulls_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)], i) for i in range(230)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [NAN, 1.0], 1), (None, [1.0], 1), (100, rows[100][1], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    v = topk.quantised(df, "vec_id", "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.filter("id % 100 = 0"), 5, block=2).collect()}
    ok = [(i, [int(np.floor(1024 * x)) for x in w]) for i, w, _ in rows if i is not None and w and all(x is not None and x == x for x in w)]
    for q in (0, 100, 200):
        qw = next(w for i, w in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(qw, w)), i) for i, w in ok if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 15
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://x.net/", "http://net/a", "http://planet/a", "http://example.com/de/1", "http://example.com/den", "ftp://b.org/fr/#z", None, "no scheme", "http://a.net?x", "http://q.example.com/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    want = [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("x.net", "/", "net/", "block"), ("net", "/a", "net/", "block"), ("planet", "/a", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/den", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.net", "", None, "allow"), ("q.example.com", "/de/", "example.com/de/", "block"),
    ]
    assert [got[i] for i in range(22)] == want * 2
    assert url_filter.judge(df.limit(0)).count() == 0


def test_cascade_is_exact_and_keeps_leftovers(monkeypatch):
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 2**63, 30_000).astype(np.uint64), rng.integers(0, 2**63, 30_000).astype(np.uint64)
    for share in (0.0, 0.001, 0.3, 0.97, 1.0):
        listed = rng.random(30_000) < share
        assert (url_filter.member(url_filter.build(h1, h2, listed), h1, h2) == listed).all()
    for levels in (1, 2, 3):
        monkeypatch.setattr(url_filter, "LEVELS", levels)
        assert (url_filter.member(url_filter.build(h1, h2, listed), h1, h2) == listed).all()


def test_filters_in_several_shards_and_passes(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 50)
    monkeypatch.setattr(url_filter, "PASS_BYTES", 200)
    df = spark.range(600).select(F.concat(F.lit("k"), F.col("id") % 300).alias("key"), (F.col("id") % 300 % 7 == 0).alias("want"))
    out = url_filter.with_membership(df, "key", url_filter.cascades(df, "key", "want"))
    assert out.count() == 600 and out.filter("listed <> want").count() == 0


def brute_schedule(blocks, weights):
    """Each slot by looking at all sources: of those whose next block is released, the one due first."""
    done, start, first, slot, out = [0] * len(blocks), 0, [0] * len(blocks), 0, []
    while any(d < b for d, b in zip(done, blocks)):
        left = [k for k in range(len(blocks)) if done[k] < blocks[k]]
        w = {k: Fraction(weights[k]) for k in left if weights[k]} or {k: Fraction(1) for k in left}
        total, phase_over = sum(w.values()), False
        while not phase_over:
            ready = []
            for k, x in w.items():
                i = done[k] - first[k]
                if floor(i * total / x) <= slot - start:
                    ready.append((ceil((i + 1) * total / x), k))
            due, k = min(ready)
            i = done[k] - first[k]
            out.append((k, done[k], slot, start + floor(i * total / w[k]), start + due))
            done[k] += 1
            slot += 1
            for s, x in w.items():  # less than one block off, all through the phase
                assert abs(done[s] - first[s] - (slot - start) * x / total) < 1
            if phase_over := done[k] == blocks[k]:
                start, first = slot, list(done)
    return out


def test_whole_schedules_match_brute_force():
    rng = random.Random(11)
    for _ in range(12):
        n = rng.randint(1, 6)
        blocks, weights = [rng.randint(1, 60) for _ in range(n)], [rng.choice([0.0, 0.1, 0.5, 1.0, 3.7, rng.random()]) for _ in range(n)]
        assert list(mixing.Schedule(blocks, mixing.exact(weights))) == brute_schedule(blocks, weights)


def test_mixing_keeps_all_rows_and_places(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}", 7) for i in range(3000)] + [(5000, None, 1), (5000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _slot int")
    out = mixing.schedule(df, weights={"big": 2.0, "s0": 1.0}, block_docs=4)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert len({r.position for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    per = {}
    for r in got:
        per.setdefault((r.source, r.block), set()).add(r.slot)
    assert all(len(x) == 1 for x in per.values())
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == len(rows)
    assert mixing.schedule(df.limit(0)).count() == 0


def test_mixing_takes_exact_weights(spark, monkeypatch):
    for weights, slots in (([(k + 1) ** 0.5 for k in range(20)], 20000), ([0.0001, 0.9999], 30000), (list(range(1, 2601)), 4000)):
        share, done, every = [w / sum(weights) for w in weights], [0] * len(weights), max(1, len(weights) // 50)
        for k, i, slot, release, due in islice(mixing.Schedule([slots + 1] * len(weights), mixing.exact(weights)), slots):
            assert release <= slot < due and i == done[k]
            done[k] += 1
            if slot % every == 0:
                assert all(abs(n - (slot + 1) * x) < 1 + 1e-6 for n, x in zip(done, share, strict=True))
    blocks, weights = [40, 7, 300, 5], mixing.exact([2.0, 1.0, 3.5, 0.0])
    whole = list(mixing.Schedule(blocks, weights))
    parts = [x for state in mixing.epochs(blocks, weights, 13) for x in islice(mixing.Schedule(blocks, weights, state), 13)]
    assert parts == whole and len(whole) == 352 and [x[0] for x in whole[-5:]] == [3] * 5
    monkeypatch.setattr(mixing, "EPOCH", 10)
    monkeypatch.setattr(mixing, "BUCKET", 50)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("source"))
    got = mixing.schedule(df, "id", weights={"a": 0.9, "b": 0.1}, block_docs=3).collect()
    assert len(got) == len({r.position for r in got}) == 1000 and {r.slot for r in got} == set(range(334))
    rare = spark.range(9000).select("id", F.when(F.col("id") < 8998, "a").otherwise("b").alias("source"))
    got = mixing.schedule(rare, "id", weights={"a": 9998.0, "b": 2.0}, block_docs=1).filter("source = 'b'").collect()
    assert min((r.release, r.deadline) for r in got) == (0, 5000)


def test_fingerprint_report(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(300)) for _ in range(n)) for n in (0, 1, 4, 9, 200, 400, 31)] + ["é" * 9, None]
    texts += [texts[4]]
    df = spark.createDataFrame([(2 * i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    assert len(got) == len(texts)
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        k, after = len(t) // 4, full[(i + 1) % len(full)]
        want = t[: len(t) - k] + after[:k]
        r = got[2 * i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 32
    assert got[8].fingerprint == got[18].fingerprint and got[0].fingerprint == got[16].fingerprint
    assert got[10].near_edited > 0.65 > got[10].near_next
    assert fingerprints.fingerprint_report(df.limit(0)).count() == 0
    assert fingerprints.fingerprint_report(df.limit(1)).count() == 1


def brute_bits(text):
    """All 128 bits from the hashes of the terms, by the reference implementation of the hash."""
    long = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()]
    terms = [words] if len(words) <= 5 else [words[i : i + 5] for i in range(len(words) - 4)]
    first = []
    for term in terms:
        h = 42
        for w in term:
            h = long(w, h)
        first.append(h)
    second = [xxhash.xxh64_intdigest(struct.pack("<I", 7919), long(h, 42)) for h in first]
    side = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))
    return side(first), side(second)


def test_fingerprints_match_brute_force_in_every_bit(spark):
    rng = random.Random(13)
    texts = [" ".join(str(rng.randrange(90)) for _ in range(n)) for n in (0, 1, 3, 5, 6, 7, 30, 120, 121)] + [None, "A b\tc D e F g H a b c d e f"]
    texts += [" ".join([*texts[7].split()[:-1], "changed"]), texts[7]]
    rows = [(100 * i, t, 1) for i, t in enumerate(texts)] + [(500, texts[5], 2), (None, "no id", 3), (None, "no id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    out = fingerprints.fingerprint_report(df).collect()
    assert len(out) == len(rows) and [r.doc_id for r in out].count(500) == 2 and [r.doc_id for r in out].count(None) == 2
    got = {r.doc_id: r for r in out}
    bits = {i: brute_bits(t) for i, t, _ in rows[: len(texts)]}
    assert all(got[i].fingerprint == f"{a:016x}{b:016x}" for i, (a, b) in bits.items())
    far = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
    for i, x in bits.items():
        near = {y for y in bits.values() if 0 < far(x, y) <= fingerprints.RADIUS}
        same = [j for j, y in bits.items() if j != i and (y in near or y == x)]
        assert (got[i].near_fingerprints, got[i].near_doc) == (len(near), min(same, default=None))


def test_within_radius_matches_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = [b ^ sum(1 << rng.randrange(128) for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))) & ((1 << 128) - 1) for b in base for _ in range(5)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x & (2**64 - 1)), signed(x >> 64)) for i, x in enumerate(fps)], "id long, fp0 long, fp1 long")
    got = {(r.query_id, r.id): r.distance for r in fingerprints.within_radius(df, df.filter("id % 3 = 0")).collect()}
    want = {(i, j): d for i, x in enumerate(fps) if i % 3 == 0 for j, y in enumerate(fps) if i != j and (d := (x ^ y).bit_count()) <= 3}
    assert got == want and want

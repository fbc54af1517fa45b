"""The prefix trie against a plain version, also where conversations are long, hot or lie in several ranges."""

import hashlib
import random
import re
import zlib

import pytest
from codonlake.llm import prefix_trie, shared
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            found.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in found.items()}


def begun(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def plain(convs):
    """Every node from its members, and subtrees by looking at every pair of nodes."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {p: [0, 0] for p in members}
    for p, own in members.items():
        saved = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += saved
            sums[p[:d]][1] += p not in children
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children.get(p, [])), sums[p][1], sums[p][0], sha(p)) for p, own in members.items())


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    turns = [("user", "lo mi"), ("user", ""), ("assistant", "ka tu\n lo"), (None, None), ("user", "é  ü"), ("system", "x")]
    out = []
    for c in [*range(0, 90), *range(400, 500, 3), -7, -20, -40, -45, 2**40 + 3, 2**40 - 2**40 % 20]:
        for t in range(rng.randint(1, 7)):
            out.append((c, rng.choice([t, t, t, None, 3]), *rng.choices(turns, (9, 2, 9, 1, 1, 5))[0]))
    out += [(600 + k, t, "user", "same words here") for k in range(60) for t in range(3)]  # copies
    out += [(None, 1, "user", "nobody's"), (None, None, None, None), out[3], out[3]]
    return out


def test_rebuilt_conversations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    named = df.select("*", F.lit(1).alias("depth"), F.lit("x").alias("conv"), F.lit(None).cast("int").alias("a"), F.lit(3).alias("_range"))
    found = got(prefix_trie.rebuilt_report(named))
    assert found == plain(begun(ordered(rows))) and len({r[:2] for r in found}) == len(found) > 200
    assert got(prefix_trie.rebuilt_report(df.limit(0))) == got(prefix_trie.rebuilt_report(df.filter("conv_id is null"))) == []


def test_long_and_deep_conversations(spark):
    """One conversation with most of the rows, others that leave it turn by turn, and one that goes on where it ends."""
    long = [("user", f"w{i} x") for i in range(300)]
    convs = {50: long, 51: [*long, ("user", "on")], 52: long[:200], 7: long[:299]}
    for k in range(30):
        convs[100 + k] = [*long[: 9 * k], ("user", "leaves"), ("user", "and more")][: 9 * k + 1 + k % 2]
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.prefixes_of(df)) == plain(ordered(rows))


def test_rounds_grow_with_the_logarithm(spark):
    """Each conversation leaves the one before it a turn later, in order of ids: rounds follow owners by hash, not that chain."""
    n = 120
    convs = {c: [("user", f"s{i}") for i in range(c)] + [("user", f"own {c}")] for c in range(n)}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    scratch = shared.Scratch(spark)
    own = prefix_trie.placed(scratch, prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))
    heads = own.select("conv").distinct().select("conv", F.col("conv").alias("head"), F.lit(0).alias("take"))
    nodes = prefix_trie.trie(scratch, prefix_trie.beginnings(own, heads).unionByName(own.withColumn("part", F.lit(1))))
    assert got(nodes) == plain(ordered(rows))
    rounds = [r for r in shared.names_in(spark, scratch.path) if r.startswith("done-")]
    assert len(rounds) < 20


def test_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    rows = [(c, 0, "user", "hi") for c in [*range(-9, 30), 1000, 10**12]]
    found = {r.depth: r.ends_sha256 for r in prefix_trie.prefixes_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {0: hashlib.sha256(b"").hexdigest(), 1: hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()}

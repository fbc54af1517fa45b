"""URL filters by a Bloom filter cascade: exact membership without joins.

The key universe is the corpus's distinct (host, path start) pairs; the listed keys are those that a
blocking list names. Level 1 of a cascade is a Bloom filter of the listed keys, level 2 one of the other
keys that pass level 1, level 3 one of the listed keys that pass level 2, and so on until nothing passes
wrongly. A key of the universe is listed if and only if the number of levels that it passes is odd.

The universe is split in shards by hash, of about `SHARD_KEYS` distinct keys each, whatever the corpus's
size; a shard's cascade is built in one task from the keys' 128-bit hashes. Distinct keys are pre-aggregated,
so a hot host adds nothing. Rows are judged by broadcast filters, in as many passes as keep every broadcast
under `PASS_BYTES`; each row is judged in the pass that holds its shard.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from codonlake.llm import shared

SHARD_KEYS, PASS_BYTES = 200_000, 32 << 20
#: Levels after which what still passes wrongly is kept as explicit hashes.
LEVELS = 48

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits the host or one above it and starts the path; null where none does.

    The result is a struct (rule, verdict). Rules of equal length: the first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, i: int, m: int) -> np.ndarray:
    """The i-th bit of each key in the filter of a level."""
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (a ^ (a >> np.uint64(31))) + np.uint64(i) * (h2 | np.uint64(1))
        return (x ^ (x >> np.uint64(29))) % np.uint64(m)


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """The cascade of one shard. Layout: levels; per level m, k and the bits; then the explicit hashes."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    parts, level = [], 0
    while len(inside) and level < LEVELS:
        # the first level is small where few keys are listed; later levels halve what passes
        rate = min(0.5, max(1e-6, len(inside) * math.sqrt(0.5) / max(1, len(outside)))) if level == 0 else 0.5
        k = max(1, round(-math.log2(rate)))
        m = max(64, math.ceil(len(inside) * k / math.log(2)))
        bits = np.zeros(m, np.bool_)
        for i in range(k):
            bits[_slots(h1[inside], h2[inside], level, i, m)] = True
        parts.append(struct.pack("<IB", m, k) + np.packbits(bits, bitorder="little").tobytes())
        passes = np.ones(len(outside), np.bool_)
        for i in range(k):
            passes &= bits[_slots(h1[outside], h2[outside], level, i, m)]
        inside, outside, level = outside[passes], inside, level + 1
    tail = np.stack([h1[inside], h2[inside]], 1).astype("<u8").tobytes()
    return struct.pack("<BI", len(parts), len(inside)) + b"".join(parts) + tail


def member(blob: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For keys of the universe: whether each is listed."""
    levels, extra = struct.unpack_from("<BI", blob)
    at, left, out = 5, np.arange(len(h1)), np.zeros(len(h1), np.bool_)
    for level in range(levels):
        m, k = struct.unpack_from("<IB", blob, at)
        size = (m + 7) // 8
        bits = np.frombuffer(blob, np.uint8, size, at + 5)
        at += 5 + size
        passes = np.ones(len(left), np.bool_)
        for i in range(k):
            s = _slots(h1[left], h2[left], level, i, m)
            passes &= (bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
        out[left[~passes]] = level % 2 == 1  # one that fails level 1 isn't listed, one that fails level 2 is
        left = left[passes]
    if len(left):
        known = set(np.frombuffer(blob, "<u8", 2 * extra, at).reshape(-1, 2)[:, 0].tolist()) if extra else set()
        odd = levels % 2 == 1
        # after the last level, the explicit hashes are the keys that pass it wrongly
        out[left] = np.array([odd != (x in known) for x in h1[left].tolist()], np.bool_)
    return out


def _build_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    blob = build(rows.h1.to_numpy(np.int64).view(np.uint64), rows.h2.to_numpy(np.int64).view(np.uint64), rows.listed.to_numpy(np.bool_))
    return pd.DataFrame({"shard": [key[0]], "blob": [blob], "size": [len(blob)]})


def cascades(keys: DataFrame, key_col: str, listed_col: str) -> DataFrame:
    """shard, blob, size over a universe of keys (repeats allowed); kept in the checkpoint folder.

    A key that is listed in any of its rows is listed. The number of shards follows the number of keys."""
    distinct = shared.cut(keys.groupBy(F.xxhash64(F.col(key_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(key_col)).alias("h2")).agg(F.max(listed_col).alias("listed")))
    n_shards = max(1, -(-distinct.count() // SHARD_KEYS))
    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("h1", F.lit(2)), F.lit(n_shards)).cast("int"))
    return shared.cut(sharded.groupBy("shard").applyInPandas(_build_group, "shard int, blob binary, size long")).withColumn("n_shards", F.lit(n_shards))


def _judge(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs = held.value
        for batch in batches:
            h1, h2 = batch.h1.to_numpy(np.int64).view(np.uint64), batch.h2.to_numpy(np.int64).view(np.uint64)
            out = np.zeros(len(batch), np.bool_)
            shards = batch.shard.to_numpy()
            for s in np.unique(shards):
                rows = np.flatnonzero(shards == s)
                out[rows] = member(blobs[int(s)], h1[rows], h2[rows])
            yield out

    return run


def with_membership(rows: DataFrame, key_col: str, filters: DataFrame, listed_col: str = "listed") -> DataFrame:
    """The rows with whether they are listed, from their shards' cascades; all keys must be of the universe.

    A null key is one like others; repeated rows stay repeated; keys may be of any length. A result column whose
    name the rows have gets an underscore more; other columns may have any names, types and nulls."""
    listed_col = shared.free_names(rows, listed_col)[0]
    spark = rows.sparkSession
    # running totals deal the shards to passes of bounded bytes; there is one row for each SHARD_KEYS distinct keys
    plan = filters.select("shard", "size", "n_shards").collect()
    if not plan:
        return rows.withColumn(listed_col, F.lit(False))
    n_shards, groups, room = plan[0].n_shards, [[]], PASS_BYTES
    for r in sorted(plan, key=lambda r: r.shard):
        if r["size"] > room and groups[-1]:
            groups.append([])
            room = PASS_BYTES
        groups[-1].append(r.shard)
        room -= r["size"]
    h1 = F.xxhash64(F.col(f"`{key_col}`"))
    ready = shared.packed(rows, h1=h1, h2=F.xxhash64(F.lit(1), F.col(f"`{key_col}`")), shard=F.pmod(F.xxhash64(h1, F.lit(2)), F.lit(n_shards)).cast("int"))
    schema = StructType([*ready.schema.fields, StructField("listed", BooleanType())])
    out = None
    for g in groups:
        blobs = {r.shard: bytes(r.blob) for r in filters.filter(F.col("shard").between(g[0], g[-1])).select("shard", "blob").collect()}
        part = ready if len(groups) == 1 else ready.filter(F.col("shard").between(g[0], g[-1]))
        judged = part.mapInArrow(_beside(_judge(spark.sparkContext.broadcast(blobs))), schema)
        out = judged if out is None else out.unionByName(judged)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns], F.col("listed").alias(listed_col))


def _beside(judge):
    """The batches with what the judge gives for their hashes; the rows themselves stay Arrow data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).to_pandas()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(next(judge(iter([hashes]))))], names=[*batch.schema.names, "listed"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The listed keys are those of the universe that the rules block; a key is the host and as much of the
    path as any rule looks at. The verdict is the cascade's: block if the key is listed. Null urls and urls
    without :// have an empty host and path, fit no rule and are allowed. Repeated rows stay repeated; an
    empty table gives no rows."""
    reach = max((len(p) for _, _, p in rules), default=0)
    u = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host(u).alias("host"), path(u).alias("path"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", fit["rule"]).withColumn("key", F.concat(F.col("host"), F.lit(" "), F.substring("path", 1, reach)))
    universe = rows.select("key", F.coalesce(fit["verdict"] == "block", F.lit(False)).alias("listed"))
    out = with_membership(rows, "key", cascades(universe, "key", "listed"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))

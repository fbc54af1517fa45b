"""Document fingerprints: SimHash with native DataFrame functions only.

Terms are runs of five words; a text with fewer words is one term, and a text without words (null
included) has the empty term. Each occurrence of a term votes for or against each of 128 bits, so a
term's weight is its count. Votes are sums of counters of 32 bits, two to a long, so they are plain `sum`
aggregates: Spark adds them up on the map side, a document is never gathered, and what is shuffled is a
row of sums for each document and task. A text of under 2^31 terms can't overflow a counter, and no string
is longer than that.

Radius search (`within_radius`): a fingerprint is cut in radius + extra blocks. Two fingerprints within
the radius agree in at least `extra` whole blocks, so the permuted tables, one for each choice of `extra`
blocks, hold every such pair. Queries are a stated set; equal fingerprints are searched once and members
joined on afterwards, so groups of copies add no pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared

WORDS = 5
LANES = 32
#: Differing bits, of 128, of what the report counts as near: texts of a similarity of about 0.95.
RADIUS = 8
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
#: The second 64 bits hash the first ones again, with this seed.
SEED = 7919


def words(text: Column) -> Column:
    """Lower-case words between white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def term_hashes(text: Column, k: int = WORDS) -> Column:
    """A 64-bit hash for each term, from the hashes of its words."""
    h = F.transform(words(text), lambda w: F.xxhash64(w))
    # nested, so that the words are hashed once
    return F.element_at(
        F.transform(
            F.array(h),
            lambda a: F.when(F.size(a) <= k, F.array(F.xxhash64(a))).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(a, i, k)))
            ),
        ),
        1,
    )


def _votes() -> list[Column]:
    """Sums over terms, each of two counters: bit j in the low half of a long, bit j + 32 in the high half."""
    low = lambda h, j: F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit(0x0000000100000001))
    return [F.sum(low(h, j)).alias(f"{h}_{j}") for h in ("h0", "h1") for j in range(LANES)]


def _word(h: str) -> Column:
    """The 64 bits: 1 where at least half of the terms have the bit."""
    bits = []
    for b in range(64):
        lane = F.col(f"{h}_{b % LANES}")
        ones = F.shiftrightunsigned(lane, 32) if b >= LANES else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        bits.append(F.when(ones * 2 >= F.col("n_terms"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return out


def fingerprint(docs: DataFrame, keys: list[str], text: str, k: int = WORDS) -> DataFrame:
    """The keys, fp0 and fp1 (long, 64 bits each): the SimHash of the text of each distinct value of the keys.

    A tie of votes gives 1. Null, empty and blank texts have the fingerprint of the empty term, so all of
    them are alike. Rows with equal keys are taken as one document. An empty table gives no rows."""
    t = docs.select(*keys, F.explode(term_hashes(F.col(text), k)).alias("h0")).withColumn("h1", F.xxhash64("h0", F.lit(SEED)))
    sums = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_terms"), *_votes())
    return sums.select(*keys, _word("h0").alias("fp0"), _word("h1").alias("fp1"))


def as_hex(fp0: Column, fp1: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(part(fp0), part(fp1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1 less the share of the 128 bits that differ."""
    return F.lit(1.0) - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(128.0)


def successors(ids: DataFrame, key: str) -> DataFrame:
    """key, next_key for distinct keys: the next larger one; the smallest after the largest.

    Only keys move: they are dealt by range and kept, so a range's number stays the same when an executor is
    lost; inside a range a window finds the next key, and the last of each range takes the first key of the
    next range, from a table of one row for each range."""
    n = shared.partitions(ids.sparkSession)
    dealt = shared.cut(ids.select(key).distinct().repartitionByRange(n, key).withColumn("pid", F.spark_partition_id()))
    firsts = dealt.groupBy("pid").agg(F.min(key).alias("first"))
    after = firsts.select("pid", F.lead("first").over(W.orderBy("pid")).alias("after"))
    start = firsts.agg(F.min("first").alias("start"))
    found = dealt.select(key, "pid", F.lead(key).over(W.partitionBy("pid").orderBy(key)).alias("inner"))
    # both joined tables have at most a row for each range
    found = found.join(F.broadcast(after), "pid", "left").join(F.broadcast(start))
    return found.select(key, F.coalesce("inner", "after", "start").alias("next_key"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, tag, text, edited, n_chars, next_key: the last quarter of each text replaced by the start of the next document.

    Null text is empty. Null ids come before all others and share one place. Of several texts with one id,
    each is a row, and the one with the least 64-bit hash stands for the id as next document; repeats of id
    and text are one row. With one id only, a document is its own next one."""
    lowest = F.lit(NO_ID).cast("long")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    need = base.groupBy("key").agg(F.max(F.expr("length(text) div 4")).alias("k"))
    links = successors(base, "key").join(need, "key")
    tails = (
        base.join(links.select(F.col("key").alias("for_key"), F.col("next_key").alias("key"), "k"), "key")
        .select(F.col("for_key").alias("key"), F.col("key").alias("next_key"), F.expr("substr(text, 1, k)").alias("tail"), F.xxhash64("text").alias("t"))
        .groupBy("key", "next_key")
        .agg(F.min_by("tail", "t").alias("tail"))
    )
    out = base.join(tails, "key").withColumn("n_chars", F.length("text").cast("long"))
    k = F.expr("n_chars div 4")
    return out.select(
        "key", F.xxhash64("text").alias("tag"), "text", "n_chars", "next_key",
        F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring(F.col("tail"), F.lit(1), k.cast("int"))).alias("edited"),
    )


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints, near_doc for every row.

    The last two are for rows whose id `every` divides, and null for others: how many other fingerprints lie within
    the radius, and the least other id with one of those or with the same one. See `edited_pairs` for nulls,
    repeats and single documents; rows equal in id and text have equal results, and each is returned. Other
    columns are not read."""
    rows = edited_pairs(docs, id_col, text_col).withColumn("sha", F.sha2(F.col("edited"), 256))
    keys = ["key", "next_key", "tag", "n_chars", "sha"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("x")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("x")))).alias("s"))
    fps = fingerprint(both.select(*keys, "s.v", "s.x"), [*keys, "v"], "x", k)
    pick = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    wide = fps.groupBy(*keys).agg(pick(0, "fp0").alias("a0"), pick(0, "fp1").alias("a1"), pick(1, "fp0").alias("e0"), pick(1, "fp1").alias("e1"))
    wide = shared.cut(wide)
    heads = wide.groupBy(F.col("key").alias("next_key")).agg(F.min_by(F.struct("a0", "a1"), F.col("tag")).alias("b"))
    again = repeats(docs, id_col, text_col)
    near = neighbours(wide.filter(F.col("key") != NO_ID).select(F.col("key").alias("id"), F.col("a0").alias("fp0"), F.col("a1").alias("fp1"), "tag"), every, radius)
    out = wide.join(heads, "next_key").join(near.withColumnRenamed("id", "key"), ["key", "tag"], "left").join(again, ["key", "tag"], "left")
    a, e = (F.col("a0"), F.col("a1")), (F.col("e0"), F.col("e1"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return out.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        as_hex(*a).alias("fingerprint"), as_hex(*e).alias("edited_fingerprint"),
        likeness(*a, *e).alias("near_edited"), likeness(*a, F.col("b.a0"), F.col("b.a1")).alias("near_next"), "near_fingerprints", "near_doc",
    )


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, tag, copies for what is on several rows."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    return rows.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def neighbours(fps: DataFrame, every: int, radius: int) -> DataFrame:
    """id, tag, near_fingerprints, near_doc for the rows of fps (id, tag, fp0, fp1) whose id `every` divides."""
    one = fps.groupBy("fp0", "fp1").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    asked = fps.filter(F.col("id") % every == 0)
    pairs = fingerprint_pairs(one, asked.select("fp0", "fp1").distinct(), radius).filter("distance > 0")
    low = one.select(F.col("fp0").alias("g0"), F.col("fp1").alias("g1"), "low")
    found = shared.sieve(low, pairs, "g0").join(pairs, ["g0", "g1"]).groupBy("fp0", "fp1").agg(F.count(F.lit(1)).alias("near_fingerprints"), F.min("low").alias("low_near"))
    same = shared.sieve(one, asked, "fp0").select("fp0", "fp1", "low", "high")
    out = asked.join(same, ["fp0", "fp1"], "left").join(found, ["fp0", "fp1"], "left")
    own = F.when(F.col("low") != F.col("id"), F.col("low")).when(F.col("high") != F.col("id"), F.col("high"))
    return out.select("id", "tag", F.coalesce("near_fingerprints", F.lit(0).cast("long")).alias("near_fingerprints"), F.least(own, F.col("low_near")).alias("near_doc"))


def _blocks(n: int) -> list[tuple[int, int]]:
    """n near-equal bit ranges of 128 bits."""
    at = [128 * i // n for i in range(n + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def fingerprint_pairs(fps: DataFrame, queries: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """(fp0, fp1, g0, g1, distance) for all distinct fingerprints of the queries and those of fps that differ in at most `radius` bits.

    Exact: every permuted table is searched. Keys that no query has are sieved out before the tables move."""
    blocks = _blocks(radius + extra)

    def bits(lo: int, hi: int) -> Column:
        get = lambda c, a, b: F.shiftrightunsigned(F.col(c), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
        if hi <= 64 or lo >= 64:
            return get("fp0" if hi <= 64 else "fp1", lo % 64, hi - 64 * (lo >= 64))
        return get("fp0", lo, 64).bitwiseXOR(F.shiftleft(get("fp1", 0, hi - 64), 64 - lo))

    def keyed(df: DataFrame) -> DataFrame:
        choices = combinations(range(len(blocks)), extra)
        keys = F.array(*[F.xxhash64(F.lit(i), *[bits(*blocks[b]) for b in chosen]) for i, chosen in enumerate(choices)])
        return df.select("fp0", "fp1", F.explode(keys).alias("k"))

    q, f = keyed(queries.select("fp0", "fp1").distinct()), keyed(fps.select("fp0", "fp1").distinct())
    f = shared.sieve(f, q, "k").select(F.col("fp0").alias("g0"), F.col("fp1").alias("g1"), "k")
    far = F.bit_count(F.col("fp0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("fp1").bitwiseXOR(F.col("g1")))
    return q.join(f, "k").withColumn("distance", far).filter(F.col("distance") <= radius).select("fp0", "fp1", "g0", "g1", "distance").distinct()


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """fps and queries (id, fp0, fp1): query_id, id, distance for all pairs of at most `radius` differing bits.

    Pairs of a row with its own id are left out. A query is paired with every member of a near fingerprint's group,
    so take a stated set of queries, or `neighbours`, which names one. Repeated rows give repeated pairs; rows with
    a null fingerprint have no pairs. Empty tables give no rows. Exact: every table is searched."""
    near = fingerprint_pairs(fps, queries, radius, extra)
    members = fps.select("id", F.col("fp0").alias("g0"), F.col("fp1").alias("g1"))
    out = queries.select(F.col("id").alias("query_id"), "fp0", "fp1").join(near, ["fp0", "fp1"]).join(members, ["g0", "g1"])
    return out.filter(F.col("query_id") != F.col("id")).select("query_id", "id", "distance")

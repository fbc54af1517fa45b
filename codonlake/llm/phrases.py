"""Phrases that stand together more often than their parts, mined by naming pairs level by level.

Words that are frequent enough get names. Two adjacent names of one level that are frequent as a pair get a name of
the next level, so a name of level k stands for k words and its two halves, the names of its first and of its last k - 1
words, are pointers to parents. Counts of all first and last parts (for the cuts of a phrase) and what a phrase is
contained in are found by following those pointers; no text is read again for them.

The corpus is read three times: for words, for adjacent pairs of frequent words, and for runs of at least three words
whose adjacent pairs are frequent. Equal runs are counted once with their number. What follows replaces pairs in the
runs by the joined names of the next level and keeps the stretches without a gap, so that the data shrinks at every
level. Before the names are joined, bitmaps of fixed size sieve out most words and pairs that aren't frequent; what passes
wrongly is counted exactly and found to be rare, or has no name to join.

A word is known by a 64-bit hash in the runs. The table of all distinct words tells whether a frequent one shares its hash
with another; if so, hashes are salted anew until none does, so that names are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared
from codonlake.llm.textarrays import Hasher, chunks, mix

#: Bits of a sieve of names; as a table it has at most a 64th as many rows.
BITS = 26
#: Characters worked on at once, distinct entries that a task holds before it hands them on, and salts that are tried.
CHARS, HELD, SALTS = 2_000_000, 600_000, 16
#: Parts that the ranking of one language is dealt to before the last choice.
DEAL = 64
_PIECE, _WORD = ".,;:!?\n\x0b\x0c\r", " \t"


class _Tokens:
    """The words of some texts: hash, whether the next word follows in the same piece, and where they stand."""

    def __init__(self, texts: list[str], salt: int) -> None:
        raw = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.low = np.where((raw >= 65) & (raw <= 90), raw + np.uint32(32), raw)
        cuts, gaps = (np.isin(raw, np.array([ord(c) for c in s], np.uint32)) for s in (_PIECE, _WORD))
        inside = ~(cuts | gaps)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        piece = np.cumsum(cuts)[self.start]
        self.hash = Hasher(self.low.astype(np.uint64) + (np.uint64(salt) << np.uint64(32))).of(self.start, self.end)
        self.next = piece[1:] == piece[:-1]

    def text(self) -> str:
        return self.low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _by_lang(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[tuple[str, _Tokens]]:
    """(language, words) of a bounded number of characters at a time, or of one text."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        groups: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            if text:
                groups.setdefault(lang, []).append(text)
        for lang, own in groups.items():
            for a, b in chunks(own, CHARS):
                yield lang, _Tokens(own[a:b], salt)


def _key(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode("utf-8", "surrogatepass"))], np.uint64))[0]


def _slots(lang: str, names: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The bit of a sieve for each name, or pair of names, of a language."""
    with np.errstate(over="ignore"):
        x = mix(names ^ _key(lang))
        return (mix(x if then is None else x + mix(then)) >> np.uint64(64 - BITS)).astype(np.int64)


def _passes(sieve: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (sieve[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def _sieve(names: DataFrame, pair: bool):
    """A broadcast bitmap of the names (lang, left[, right]); its table comes to the driver in at most 2^20 rows of 16 bytes."""
    spark = names.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            left = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            right = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) if pair else None
            slot = np.zeros(len(left), np.int64)
            for lang in set(langs.tolist()):
                own = langs == lang
                slot[own] = _slots(lang, left[own], right[own] if pair else None)
            word, code = np.unique(slot >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, code, np.uint64(1) << (slot & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    words = names.select("lang", "left", *(["right"] if pair else [])).mapInArrow(work, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def _alike(t: _Tokens, first: np.ndarray, code: np.ndarray) -> bool:
    """Whether all words of a hash are the word that stands first, letter by letter."""
    size = t.end - t.start
    if (size != size[first][code]).any():
        return False
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return bool((t.low[np.repeat(t.start, size) + step] == t.low[np.repeat(t.start[first][code], size) + step]).all())


def _word_counts(docs: DataFrame, salt: int) -> DataFrame:
    """(lang, left: hash, word, n), counted over a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [pa.array([k[0] for k in held], pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([k[1] for k in held], pa.string()), pa.array([v[1] for v in held.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["lang", "left", "word", "n"])

        for lang, t in _by_lang(batches, salt):
            found, first, code, count = np.unique(t.hash, return_index=True, return_inverse=True, return_counts=True)
            low = t.text()
            if _alike(t, first, code):
                items = zip(found.view(np.int64).tolist(), t.start[first].tolist(), t.end[first].tolist(), count.tolist(), strict=True)
            else:
                items = zip(t.hash.view(np.int64).tolist(), t.start.tolist(), t.end.tolist(), [1] * len(t.hash), strict=True)
            for h, a, b, n in items:
                v = held.get((lang, low[a:b]))
                if v is None:
                    held[lang, low[a:b]] = [h, n]
                else:
                    v[1] += n
            if len(held) > HELD:
                yield out()
        yield out()

    found = docs.mapInArrow(work, "lang string, left long, word string, n long")
    # all rows of a hash in one place, at most one for each task and word
    return found.repartition("lang", "left").groupBy("lang", "left", "word").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs with the sums of their counts."""
    left, right, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    key = code[: len(left)].astype(np.int64) * len(names) + code[len(left) :]
    found, inverse = np.unique(key, return_inverse=True)
    return names[found // len(names)], names[found % len(names)], np.bincount(inverse, n).astype(np.int64)


def _pair_counts(docs: DataFrame, salt: int, sieve) -> DataFrame:
    """(lang, left, right, n) of adjacent words that pass the sieve, counted over a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out(lang: str) -> pa.RecordBatch:
            left, right, n = _merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(n)], names=["lang", "left", "right", "n"])

        for lang, t in _by_lang(batches, salt):
            ok = _passes(sieve.value, _slots(lang, t.hash))
            at = np.flatnonzero(ok[:-1] & ok[1:] & t.next)
            if not len(at):
                continue
            held.setdefault(lang, []).append(_merged([(t.hash[at], t.hash[at + 1], np.ones(len(at)))]))
            size += len(held[lang][-1][0])
            if size > 2 * HELD:
                held = {x: [_merged(p)] for x, p in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD:
                    for x in list(held):
                        yield out(x)
                    size = 0
        for x in list(held):
            yield out(x)

    return docs.mapInArrow(work, "lang string, left long, right long, n long").groupBy("lang", "left", "right").agg(F.sum("n").alias("f"))


def _runs(docs: DataFrame, salt: int, words, pairs) -> DataFrame:
    """(lang, names, times): runs of three words or more whose words and adjacent pairs pass the sieves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([0, *[len(k[1]) // 8 for k in held]]).astype(np.int32)
            names = np.frombuffer(b"".join(k[1] for k in held), np.int64)
            rows = [pa.array([k[0] for k in held], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(names)), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["lang", "names", "times"])

        for lang, t in _by_lang(batches, salt):
            ok = _passes(words.value, _slots(lang, t.hash))
            at = np.flatnonzero(ok[:-1] & ok[1:] & t.next)
            good = np.zeros(len(t.hash) + 1, bool)
            good[1:][at] = _passes(pairs.value, _slots(lang, t.hash[at], t.hash[at + 1]))
            edge = np.flatnonzero(good[1:] != good[:-1])
            a, b = edge[::2], edge[1::2]  # pairs a to b - 1
            long = b - a >= 2
            data = t.hash.tobytes()
            for i, j in zip((a[long] * 8).tolist(), (b[long] * 8 + 8).tolist(), strict=True):
                k = lang, data[i:j]
                if k in held:
                    held[k] += 1
                else:
                    held[k] = 1
                    size += j - i
            if len(held) > HELD or size > 64_000_000:
                yield out()
                size = 0
        yield out()

    return docs.mapInArrow(work, "lang string, names array<long>, times long").groupBy("lang", "names").agg(F.sum("times").alias("times"))


def _pairs_of(runs: DataFrame) -> DataFrame:
    """(run, lang, times, pos, left, right): adjacent names of the runs."""
    n = F.size("names") - 1
    both = F.arrays_zip(F.slice("names", 1, n).alias("left"), F.slice("names", 2, n).alias("right"))
    return runs.select("run", "lang", "times", F.posexplode(both).alias("pos", "p")).select("run", "lang", "times", "pos", "p.left", "p.right")


def _replaced(runs: DataFrame, names: DataFrame) -> DataFrame:
    """(lang, names, times): the stretches of at least two joined names of adjacent pairs, equal ones together."""
    key = F.struct("lang", "left", "right").alias("key")
    rows = _pairs_of(runs).select("run", "lang", "times", "pos", key)
    found = shared.join_unique(rows, names.select(key, "id"), "key", "run", "inner", broadcast=False)
    island = found.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("run").orderBy("pos")))
    whole = island.groupBy("run", "island").agg(F.first("lang").alias("lang"), F.first("times").alias("times"), F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("all"))
    return whole.filter(F.size("all") > 1).select("lang", F.col("all.id").alias("names"), "times").groupBy("lang", "names").agg(F.sum("times").alias("times"))


def _named(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Frequent pairs with what their parents tell: the phrase, its last word, and the counts of its first and last parts."""
    first = below.select(F.struct("lang", F.col("id").alias("left")).alias("key"), F.col("phrase").alias("_phrase"), F.col("firsts").alias("_firsts"))
    rest = below.select(F.struct("lang", F.col("id").alias("right")).alias("key"), "last", F.col("lasts").alias("_lasts"))
    rows = shared.join_unique(pairs.withColumn("key", F.struct("lang", "left")), first, "key", "id", "inner", broadcast=False).drop("key")
    rows = shared.join_unique(rows.withColumn("key", F.struct("lang", "right")), rest, "key", "id", "inner", broadcast=False).drop("key")
    return rows.select(
        "id", "lang", "left", "right", "f", "last", F.concat_ws(" ", "_phrase", "last").alias("phrase"),
        F.concat("_firsts", F.array("f")).alias("firsts"), F.concat("_lasts", F.array("f")).alias("lasts"),
    )


def names(scratch: shared.Scratch, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all words) and the names of each level, from single words on.

    A name has id, lang, phrase, last (word), f (its occurrences), firsts and lasts (occurrences of its first and last 1, 2, ...
    words); above single words also left and right, the ids of its parents."""
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    for salt in range(SALTS):
        counts = scratch.keep(f"words-{salt}", _word_counts(docs, salt))
        twice = counts.groupBy("lang", "left").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).filter((F.col("words") > 1) & (F.col("n") >= least))
        if twice.isEmpty():
            break
        scratch.drop(f"words-{salt}")
    else:
        raise RuntimeError("frequent words share their hashes with other words under every salt")
    totals = scratch.keep("totals", counts.groupBy("lang").agg(F.sum("n").alias("n")))
    own = F.array("n")
    level = scratch.keep("names-1", counts.filter(F.col("n") >= least).select(F.col("left").alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("f"), own.alias("firsts"), own.alias("lasts")))
    scratch.drop(f"words-{salt}")
    levels = [level]
    words = _sieve(level.select("lang", F.col("id").alias("left")), False)
    runs, pairs = None, _pair_counts(docs, salt, words)
    for k in range(2, most_words + 1):
        if k > 2:
            pairs = _pairs_of(runs).groupBy("lang", "left", "right").agg(F.sum("times").alias("f"))
        # numbered once: read from the table afterwards
        found = scratch.keep(f"pairs-{k}", pairs.filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
        levels.append(scratch.keep(f"names-{k}", _named(found, levels[-1])))
        if k == most_words:
            break
        if k == 2:
            seen = _sieve(found, True)
            runs = scratch.keep("runs-1", _runs(docs, salt, words, seen).withColumn("run", F.monotonically_increasing_id()))
            words.unpersist()
            seen.unpersist()
        runs = scratch.keep(f"runs-{k}", _replaced(runs, found).withColumn("run", F.monotonically_increasing_id()))
        scratch.drop(f"runs-{k - 1}")
    scratch.only("totals", *[f"names-{k}" for k in range(1, most_words + 1)])
    return totals, levels


def _cut(n_words: int) -> Column:
    """(score, first words, l, r) of the cut that scores lowest, ties to the shortest first part. Products have up to 38 digits."""
    cuts = []
    for k in range(1, n_words):
        l, r = f"firsts[{k - 1}]", f"lasts[{n_words - k - 1}]"  # noqa: E741
        score = f"(cast(1000 * f as decimal(19,0)) * cast(n as decimal(18,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))"
        cuts.append(f"struct({score} as score, {k} as k, {l} as l, {r} as r)")
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases.

    Candidates: phrases of 2 to `most_words` words inside pieces of a text that occur at least `least` times in the
    language. One that is part of a longer candidate with at least `percent` of its occurrences is dropped: if any longer
    one is, so is one of a word more, so the two pointers to parents tell. Ties of score go to more occurrences, then to the
    phrase. A null language is `und`; null and empty texts have no words; texts are read whole; repeated rows count as
    often as they are there; an empty table gives no rows. Other columns aren't read, whatever their names."""
    scratch = shared.Scratch(docs.sparkSession)
    totals, levels = names(scratch, docs, text_col, lang_col, least, most_words)
    found = None
    for k in range(2, most_words + 1):
        level = levels[k - 1]
        if k < most_words:
            longer = levels[k].select("lang", F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("longer"))
            level = level.join(longer, ["lang", "id"], "left").filter(F.expr(f"longer is null or 100 * longer < {percent} * f"))
        one = shared.join_unique(level.select("id", "lang", "phrase", "f", "firsts", "lasts"), totals, "lang", "id", "inner", broadcast=False)
        one = one.select("lang", "phrase", F.col("f").alias("a"), "n", _cut(k).alias("cut"))
        found = one if found is None else found.unionByName(one)
    rows = found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

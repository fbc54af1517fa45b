"""Quality of texts by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words (runs of what is no white space) give hashed n-grams in families: words and pairs of words in
lower case, and one to three shapes in a row. A shape says which letters of the word are capitals, which marks
surround them and whether the word is the one before it again, so that shouting, markup and repetition are seen in
words that no labelled text has. A feature's value is its share of its family's n-grams; a text's score is the
logistic function of one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType

from codonlake.llm import shared
from codonlake.llm.language import held_out
from codonlake.llm.textarrays import LETTERS_END, Hasher, chunks, letters, mix, release

#: Labelled documents that the model is fitted on, at most: of low quality and others.
FIT_LOW, FIT_OTHER = 2000, 4000
#: Slots of hashed features (the last one is the constant); weight of a family's shares beside the constant.
BITS, SCALE = 20, 10.0
#: Rates and penalties of the updates; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 4
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _cased() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its letter in lower case (0: no letter), and whether it is a capital."""
    low = letters()
    return low, (low > 0) & (low != np.arange(LETTERS_END, dtype=low.dtype))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, slot) of every n-gram of some texts, by families."""
    low, capital = _cased()
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(codes, LETTERS_END - 1)
    letter = low[at]
    inside = ~((codes < 33) & _SPACE[np.minimum(codes, 32)])
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    base = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])[: len(texts)]
    doc = np.searchsorted(base, start, "right") - 1
    if not len(start):
        return [(doc, doc)] * 5
    word = Hasher(np.where(letter > 0, letter, codes)).of(start, end)
    upper, plain = np.concatenate([[0], np.cumsum(capital[at])]), np.concatenate([[0], np.cumsum(letter > 0)])
    n_upper, n_letters = upper[end] - upper[start], plain[end] - plain[start]
    case = np.where(n_letters == 0, 0, np.where(n_upper == 0, 1, np.where((n_upper == n_letters) & (n_letters > 1), 2, np.where(capital[at[start]] & (n_upper == 1), 3, 4))))
    mark = lambda k: np.where(letter[k] > 0, 0, codes[k]).astype(np.uint64)
    same = np.zeros(len(word), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        shape = mix(case.astype(np.uint64) + mix(same + mix(mark(start) + mix(mark(end - 1) + mix(mark(np.maximum(end - 2, start)) + np.uint64(7))))))

        def grams(x: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
            h = x[: max(0, len(x) - n + 1)]
            for k in range(1, n):
                h = mix(h) + x[k : len(x) - n + 1 + k]
            own = doc[: len(h)] == doc[n - 1 :]
            return doc[: len(h)][own], (mix(h[own] ^ np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)

        return [grams(word, 1, 0x11), grams(word, 2, 0x22), grams(shape, 1, 0x33), grams(shape, 2, 0x44), grams(shape, 3, 0x55)]


def vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sparse vector (slots in order, values) of each text, constant included."""
    n, size = len(texts), 1 << BITS
    keys, values = [np.arange(n, dtype=np.int64) * (size + 1) + size], [np.ones(n)]
    for doc, slot in features(texts):
        found, count = np.unique(doc * (size + 1) + slot, return_counts=True)
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        keys.append(found)
        values.append(SCALE * count / total[found // (size + 1)])
    key, value = np.concatenate(keys), np.concatenate(values)
    found, code = np.unique(key, return_inverse=True)
    value = np.bincount(code, value)
    cut = np.searchsorted(found, np.arange(n + 1) * (size + 1))
    return [(found[a:b] % (size + 1), value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], odds: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray | None:
    """Weights from (label, slots, values); None where the labels are all alike.

    One pass takes the examples in a random order; each moves the sums of gradients and squares of its own slots, from
    which their weights follow, zero where the sum stays within the L1 penalty. odds: of label 1 among all labelled
    documents, where the sample's differ."""
    labels = np.array([y for y, _, _ in sample], bool)
    if not len(sample) or labels.all() or not labels.any():
        return None
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sample)):
            y, slots, values = sample[i]
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - y) * values
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[slots] = ns + g * g
    out = weights(z, n)
    out[-1] += np.log((odds or labels.sum() / (~labels).sum()) * (~labels).sum() / labels.sum())
    return out.astype(np.float32)


def score(texts: list[str], weights: np.ndarray | None) -> np.ndarray:
    """Probability of label 1 for each text: the dot product as means of its n-grams' weights; 0.5 for all where nothing could be learned."""
    out = np.full(len(texts), 0.5)
    if weights is None:
        return out
    for a, b in chunks(texts):
        total = np.full(b - a, float(weights[-1]))
        for doc, slot in features(texts[a:b]):
            n = np.bincount(doc, minlength=b - a)
            total += SCALE * np.bincount(doc, weights[slot], b - a) / np.maximum(n, 1)
        out[a:b] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", low: int = FIT_LOW, other: int = FIT_OTHER) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], float | None]:
    """(label, slots, values), and the odds of label 1 among all labelled documents, of a bounded number of labelled documents,
    the first by a hash of the id. A document with labels 0 and 1 counts as low. Executors make the vectors; no text comes to the driver."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("_y"))
    pick = lambda y, n: one.filter(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(n).collect()
    chosen = [(r._id, r._y) for r in [*pick(0, low), *pick(1, other)]]
    if not chosen:
        return [], None
    n = one.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
    ids = docs.sparkSession.createDataFrame(chosen, f"_id {labels.schema[id_col].dataType.simpleString()}, _y int")
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull()).join(F.broadcast(ids), F.col("_i") == F.col("_id"))
    texts = rows.groupBy("_i", "_y").agg(F.min("_t").alias("_t"))

    def work(batch: list) -> Iterator[tuple[int, list[pa.Array]]]:
        for a, b in chunks(batch):
            found = vectors(batch[a:b])
            yield b - a, [pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))]

    found = shared.with_texts(texts, "_t", {"slots": ArrayType(IntegerType()), "values": ArrayType(FloatType())}, lambda: work).drop("_t").toArrow()
    order = np.argsort(found.column("_i").to_numpy(zero_copy_only=False), kind="stable")
    held = [found.column(c).combine_chunks() for c in ("_y", "slots", "values")]
    rows = [(held[0][int(i)].as_py(), held[1][int(i)].values.to_numpy().astype(np.int64), held[2][int(i)].values.to_numpy().astype(np.float64)) for i in order]
    return rows, n[0] / n[1] if n[0] and n[1] else None


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality", low: int = FIT_LOW, other: int = FIT_OTHER) -> DataFrame:
    """All columns of docs with a score (0 to 1, higher: better).

    Learned from at most `low` documents of low quality and `other` others, outside the held-out third of ids. A null or
    empty text gets the score of a text without words; a text is scored whole, however long. Where nothing can be
    learned every score is 0.5. Repeated rows stay repeated and score alike; an empty table gives no rows. A result
    column whose name docs has gets an underscore more; other columns may have any names, types and nulls."""
    (score_col,) = shared.free_names(docs, score_col)
    weights = train(*sample(docs.filter(~held_out(id_col, 3, 1)), labels.filter(~held_out(id_col, 3, 1)), id_col, text_col, low=low, other=other))
    release()
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB

    def work(texts: list) -> Iterator[tuple[int, list[pa.Array]]]:
        for a, b in chunks(texts := ["" if t is None else t for t in texts]):
            yield b - a, [pa.array(score(texts[a:b], held.value), pa.float64())]

    return shared.with_texts(docs, text_col, {score_col: DoubleType()}, lambda: work)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = scored(docs.select(id_col, "text"), labels, id_col)
    out = out.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col("quality").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

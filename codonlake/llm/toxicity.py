"""Toxicity by a linear-chain conditional random field that tags toxic spans.

Tokens get their labels from labelled documents: a word is labelled toxic where its document is marked toxic
and the word, or one of its beginnings, is significantly more frequent in toxic documents than in the
others. The field learns from those tokens, with whole words, affixes and transitions as features, so that
unseen inflections and neighbours count too. Forward-backward marginals over a whole text are summed up to a
document score by a logistic function fitted on the same documents; runs of likely words are the offending
offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from codonlake.llm import crf, shared
from codonlake.llm.language import held_out
from codonlake.llm.textarrays import Hasher, Words, chunks, mix, release

#: Documents that the classifier is fitted on, at most: toxic ones and others.
FIT_TOXIC, FIT_OTHER = 1500, 3000
#: Runs of words that the field is trained on, at most: around toxic words and at random; words of a run.
FIT_RUNS, LENGTH = (6000, 14000), 16
#: Beginnings of words that can be evidence; documents and ratio of rates that they need.
STEMS, LEAST_DOCS, LEAST_RATIO = (4, 5, 6, 7, 8), 12, 12.0


def _parts(texts: list[str]) -> list[Words]:
    """The words of some texts, a bounded number of characters at a time; `doc` counts from the first text."""
    out = []
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        if len(w.low) < 1 << 31:  # half the memory
            w.start, w.end = w.start.astype(np.int32), w.end.astype(np.int32)
        w.doc = (w.doc + a).astype(np.int32)
        out.append(w)
    return out


def token_labels(parts: list[Words], toxic: np.ndarray) -> list[np.ndarray]:
    """For each word, whether it counts as toxic; toxic: the documents' labels.

    A beginning counts once a document; documents don't span parts, so each part gives its own distinct pairs."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    out = [np.zeros(len(w), bool) for w in parts]

    def units(w: Words, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        u = np.flatnonzero(w.end - w.start >= (k or 1))
        return u, Hasher(w.low).of(w.start[u], w.end[u] if k is None else w.start[u] + k)

    for k in (*STEMS, None):
        hashes, docs = [], []
        for w in parts:
            u, unit = units(w, k)
            own, code = np.unique(unit, return_inverse=True)
            n = int(w.doc[-1]) + 1 if len(w) else 1
            pairs = np.unique(code.astype(np.int64) * n + w.doc[u])
            hashes.append(own[pairs // n])
            docs.append((pairs % n).astype(np.int32))
        found, code = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        d = toxic[np.concatenate(docs)]
        ones, zeros = np.bincount(code[d], minlength=len(found)), np.bincount(code[~d], minlength=len(found))
        del code, d
        marked = found[(ones >= min(LEAST_DOCS, max(4, n1 // 10))) & (ones / n1 >= LEAST_RATIO * (zeros + 0.5) / n0)]
        for x, w in zip(out, parts, strict=True):
            u, unit = units(w, k)
            x[u[np.isin(unit, marked)]] = True
    return [x & toxic[w.doc] for x, w in zip(out, parts, strict=True)]


def _summary(words: Words, post: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document: constant, log of the expected number of toxic words, highest marginal, share."""
    p = post[:, 1]
    n = np.bincount(words.doc, minlength=n_docs)
    total = np.bincount(words.doc, p, n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, words.doc, p)
    return np.stack([np.ones(n_docs), np.log1p(total), top, total / np.maximum(n, 1)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def _apart(sample: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The sample without most copies and near copies: one document for each least hash of three words in a row."""
    least: dict[int, int] = {}
    for w in _parts([t for _, t in sample]):
        h = Hasher(w.low).of(w.start, w.end)
        for i in np.unique(w.doc).tolist():
            own = h[slice(*np.searchsorted(w.doc, [i, i + 1]))]
            with np.errstate(over="ignore"):
                runs = mix(own[:-2] + mix(own[1:-1] + mix(own[2:]))) if len(own) > 2 else own
            least.setdefault(int(runs.min()), i)
    return [sample[i] for i in sorted(least.values())]


def fit(sample: list[tuple[int, str]], odds: float | None = None, seed: int = 5, runs: tuple[int, int] = FIT_RUNS):
    """(field, document weights) from (label, text); None where the labels are all alike.

    odds: of label 1 among all labelled documents, where the sample's differ. runs: of words that the field is
    trained on, at most, around toxic words and at random. Documents shorter than a run are strung together."""
    sample = _apart(sample)
    toxic = np.array([bool(x) for x, _ in sample])
    if not len(sample) or toxic.all() or not toxic.any():
        return None
    parts = _parts([t for _, t in sample])
    gold = token_labels(parts, toxic)
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    total, n_hot, n_docs = sum(map(len, parts)), sum(int(g.sum()) for g in gold), len(sample)
    for w, g in zip(parts, gold, strict=True):
        # runs of words around toxic ones, and others, inside one document; parts give in proportion to their words
        n = len(w)
        hot = rng.permutation(np.maximum(np.flatnonzero(g) - rng.integers(0, LENGTH, int(g.sum())), 0))
        starts = np.concatenate([hot[: -(-runs[0] * len(hot) // max(1, n_hot))], rng.integers(0, max(1, n - LENGTH), runs[1] * n // max(1, total) + 1)])
        starts = np.unique(starts[starts + LENGTH <= n])
        for i in rng.permutation(starts[w.doc[starts] == w.doc[starts + LENGTH - 1]]).tolist():
            texts.append(" ".join(w.text(j) for j in range(i, i + LENGTH)))
            labels.append(g[i : i + LENGTH])
    short = [(w.text(j), bool(g[j])) for w, g in zip(parts, gold, strict=True) for j in np.flatnonzero(np.bincount(w.doc, minlength=n_docs)[w.doc] < LENGTH).tolist()]
    for i in range(0, min(len(short) - LENGTH, LENGTH * runs[0]) + 1, LENGTH):
        texts.append(" ".join(x for x, _ in short[i : i + LENGTH]))
        labels.append(np.array([x for _, x in short[i : i + LENGTH]]))
    del parts, gold
    release()
    if not texts:
        return None
    model = crf.train(Words(texts), np.concatenate(labels).astype(np.int64), LENGTH, 2, prefixes=(3, 4, 5, 6), suffixes=(3, 4), trigrams=True, epochs=3)
    x = np.concatenate([_summary(w := Words([t for _, t in sample[a:b]]), model.marginals(w), b - a) for a, b in chunks([t for _, t in sample], 300_000)])
    weights = _logistic(x, toxic.astype(float))
    weights[0] += np.log((odds or toxic.sum() / (~toxic).sum()) * (~toxic).sum() / toxic.sum())
    return model, weights


def score(texts: list[str], fitted) -> np.ndarray:
    """Probability of label 1 for each text; 0.0 for all where nothing could be learned."""
    out = np.zeros(len(texts))
    if fitted is not None:
        model, weights = fitted
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            out[a:b] = 1 / (1 + np.exp(-np.clip(_summary(w, model.marginals(w), b - a) @ weights, -30, 30)))
    return out


def spans(text: str, fitted, least: float = 0.5) -> list[tuple[int, int]]:
    """Offsets of the runs of words whose marginal is at least `least`."""
    out: list[tuple[int, int]] = []
    if fitted is None:
        return out
    w = Words([text])
    hot = fitted[0].marginals(w)[:, 1] >= least
    for i in np.flatnonzero(hot):
        a, b = int(w.start[i] - w.base[0]), int(w.end[i] - w.base[0])
        if out and i and hot[i - 1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = FIT_TOXIC, other: int = FIT_OTHER) -> tuple[list[tuple[int, str]], float | None]:
    """(label, text), and the odds of label 1 among all labelled documents, of a bounded number of labelled documents, the first by a hash of the id.

    A document with labels 0 and 1 counts as toxic. Only ids are ranked; the texts of the chosen ids are read."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_y"))
    pick = lambda y, n: one.filter((F.col("_y") == 1) == F.lit(y)).orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(n).collect()
    chosen = {r._id: int(r._y == 1) for r in [*pick(True, toxic), *pick(False, other)]}
    if not chosen:
        return [], None
    n = one.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") != 1)).first()
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], f"_id {labels.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull()).join(F.broadcast(ids), F.col("_i") == F.col("_id"))
    found = rows.groupBy("_i").agg(F.min("_t").alias("_t")).collect()
    return [(chosen[r._i], r._t) for r in sorted(found, key=lambda r: r._i)], n[0] / n[1] if n[0] and n[1] else None


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity", spans_col: str | None = None, runs: tuple[int, int] = FIT_RUNS) -> DataFrame:
    """All columns of docs with a score (0 to 1), and on request the toxic spans (array of start and end).

    Learned from labelled documents outside the held-out fifth of ids; runs bounds the runs of labelled words that
    the field is trained on. A null text counts as empty and gets the score of a text without words; a text is
    scored whole, however long. Where nothing can be learned every score is 0. Repeated rows stay repeated, ties
    of score are left; an empty table gives no rows. A result column whose name docs has
    gets an underscore more; other columns may have any names, types and nulls."""
    score_col, *more = shared.free_names(docs, score_col, *([spans_col] if spans_col else []))
    spark = docs.sparkSession
    fitted = fit(*sample(docs.filter(~held_out(id_col, 5, 0)), labels.filter(~held_out(id_col, 5, 0)), id_col, text_col), runs=runs)
    release()
    held = spark.sparkContext.broadcast(fitted)

    def work(texts: list) -> Iterator[tuple[int, list[pa.Array]]]:
        for a, b in chunks(texts := ["" if t is None else t for t in texts]):
            out = [pa.array(score(texts[a:b], held.value), pa.float64())]
            if spans_col:
                out.append(pa.array([[[x, y] for x, y in spans(t, held.value)] for t in texts[a:b]], pa.list_(pa.list_(pa.int32()))))
            yield b - a, out

    new = {score_col: DoubleType()} | {name: ArrayType(ArrayType(IntegerType())) for name in more}
    return shared.with_texts(docs, text_col, new, lambda: work)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = scored(docs.select(id_col, "text"), labels, id_col)
    out = out.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col("toxicity").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents scored under the limit, with their own columns, whatever their names. Nulls and empty tables as in `scored`."""
    name = shared.free_names(docs, "toxicity")[0]
    return scored(docs, labels, id_col, text_col, name).filter(F.col(name) < limit).drop(name)

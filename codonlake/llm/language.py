"""Language identification by a linear-chain conditional random field over words.

Words are labelled with languages from affix, n-gram and whole-word (lexicon) features and learned
transitions; forward-backward gives each word's marginals, so that code-switched text gets spans, and the
mean marginals over a text are its language scores. Training sequences join runs of words of different
languages, so that transitions are learned from switches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import crf
from codonlake.llm.textarrays import Words, chunks

#: Documents of each language that the classifier is fitted on, at most, and words of a training run.
FIT_DOCS, FIT_SEQUENCES, LENGTH = 300, 6000, 24
#: Training runs for each language, where there are so many languages that `FIT_SEQUENCES` give fewer.
RUNS_EACH = 100


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int) -> list[tuple[str, str]]:
    """(lang, text) of at most `docs` documents of each language, by a hash of the id."""
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    w = W.partitionBy("lang").orderBy("h", "id")
    ids = known.select("lang", "id", F.xxhash64("id", F.lit(5)).alias("h"))
    ids = ids.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= docs).select(F.col("id").alias("_id"))
    # at most `docs` ids for each language
    rows = known.join(F.broadcast(ids.distinct()), F.col("id") == F.col("_id")).select("lang", "text", "_id").collect()
    rows = sorted((r[2], r[0], r[1]) for r in rows if r[0] is not None)
    kept: dict[str, int] = {}
    out = []
    for _, lang, text in rows:  # repeated ids
        if kept.setdefault(lang, 0) < docs:
            kept[lang] += 1
            out.append((lang, text))
    return out


def fit(sample: list[tuple[str, str]], sequences: int = FIT_SEQUENCES, length: int = LENGTH, seed: int = 3) -> tuple[list[str], crf.Model | None]:
    """Languages and the model; None where there is nothing to learn from."""
    langs = sorted({x[0] for x in sample})
    if not langs:
        return [], None
    rng = np.random.default_rng(seed)
    words = [Words([t for x, t in sample if x == lang]) for lang in langs]
    keep = [i for i, w in enumerate(words) if len(w)]
    langs, words = [langs[i] for i in keep], [words[i] for i in keep]
    texts, labels = [], []
    for _ in range(max(sequences, RUNS_EACH * len(langs))):
        seq: list[str] = []
        while len(seq) < length:
            k = int(rng.integers(len(langs)))
            n, at = min(length - len(seq), int(rng.geometric(1 / 12))), int(rng.integers(len(words[k])))
            run = [words[k].text(i) for i in range(at, min(at + n, len(words[k])))]
            seq += run
            labels += [k] * len(run)
        texts.append(" ".join(seq))
    return langs, crf.train(Words(texts), np.array(labels), length, len(langs))


def spans(text: str, langs: list[str], model: crf.Model) -> list[tuple[int, int, str]]:
    """(start, end, lang) of the runs of words with one most likely language, as offsets of the text."""
    w = Words([text])
    best = model.marginals(w).argmax(1)
    out: list[tuple[int, int, str]] = []
    for i, k in enumerate(best):
        a, b = int(w.start[i] - w.base[0]), int(w.end[i] - w.base[0])
        if out and out[-1][2] == langs[k]:
            out[-1] = (out[-1][0], b, langs[k])
        else:
            out.append((a, b, langs[k]))
    return out


def score(texts: list[str], langs: list[str], model: crf.Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of the language (-1 for none) and its mean marginal over the words."""
    best, p = np.full(len(texts), -1), np.zeros(len(texts))
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        if len(w):
            post = model.marginals(w)
            n = np.bincount(w.doc, minlength=b - a)
            mean = np.stack([np.bincount(w.doc, post[:, k], b - a) for k in range(len(langs))], 1) / np.maximum(n, 1)[:, None]
            best[a:b] = np.where(n > 0, mean.argmax(1), -1)
            p[a:b] = np.where(n > 0, mean.max(1), 0.0)
    return best, np.clip(p, 0.0, 1.0)


def predict(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """id, lang_pred, score for every row of docs, learned from the text and language of `labelled`.

    A text that is null or has no letter is `und` with score 0, and so are all where nothing can be learned.
    Repeated rows stay repeated; equal scores go to the first language by name; an empty table gives no rows."""
    spark = docs.sparkSession
    langs, model = fit(_sample(labelled, id_col, text_col, lang_col, fit_docs))
    held = spark.sparkContext.broadcast((langs, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, model = held.value
        for batch in batches:
            texts = ["" if t is None else t for t in batch.text]
            if model is None:
                best, p = np.full(len(texts), -1), np.zeros(len(texts))
            else:
                best, p = score(texts, langs, model)
            yield pd.DataFrame({"id": batch.id, "lang_pred": [langs[k] if k >= 0 else "und" for k in best], "score": p})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves the rest; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that aren't held out."""
    out = predict(docs.select(id_col, "text"), docs.filter(~held_out(id_col, 4, 2)).select(id_col, "text", "lang"), id_col)
    return out.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")


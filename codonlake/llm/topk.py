"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights, their terms the components. Candidate rows are read in Arrow
batches; a batch is inverted to postings (for each term, the rows that hold it and their weights). Queries
come in blocks of bounded size: for each query term in turn, a block scatters query weight times posting
weight into its dense score arrays, one for each query, over the batch's rows. Partition selection keeps
the k best of each query with all ties at the edge, and the partitions' lists are merged in Spark.

A pass over the candidates holds the queries of several blocks, at most about `PASS_BYTES` of them, so what is
broadcast has a fixed size; a batch is inverted once in a pass. The merged result of a pass is kept in the
shared checkpoint folder where there are several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared

#: Queries of a block, rows of a score array, bytes of the queries of a pass.
BLOCK, ROWS, PASS_BYTES = 2048, 4096, 32 << 20


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id, w (array of long): floor(scale * x) of each component as double.

    Vectors that are null or hold null or non-finite components are left out, as are rows without id."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("w"))


class Postings:
    """A batch inverted: for each term the rows that hold it and their weights. Row i is weights[offsets[i]:offsets[i + 1]]."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray) -> None:
        self.n = len(offsets) - 1
        rows = np.repeat(np.arange(self.n), np.diff(offsets))
        terms = np.arange(len(weights)) - np.repeat(offsets[:-1], np.diff(offsets))
        held = weights != 0
        order = np.argsort(terms[held], kind="stable")
        self.rows, self.weights = rows[held][order], weights[held][order]
        self.ends = np.searchsorted(terms[held][order], np.arange(int(np.diff(offsets).max(initial=0)) + 1))


def accumulate(queries: list[np.ndarray], post: Postings) -> np.ndarray:
    """Dense scores (queries x rows) of the batch, term at a time. Sums wrap at 64 bits, as SQL's long would overflow."""
    scores = np.zeros((len(queries), post.n), np.int64)
    for t in range(min(len(post.ends) - 1, max((len(q) for q in queries), default=0))):
        posted, w = post.rows[post.ends[t] : post.ends[t + 1]], post.weights[post.ends[t] : post.ends[t + 1]]
        asks = [i for i, q in enumerate(queries) if t < len(q) and q[t]]
        if len(posted) and asks:
            x = np.array([queries[i][t] for i in asks], np.int64)
            if len(posted) == post.n and len(asks) == len(queries):
                scores += x[:, None] * w[None, :]
            else:
                scores[np.ix_(asks, posted)] += x[:, None] * w[None, :]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores of one query, ties to smaller ids, without the rows of its own id."""
    free = np.flatnonzero(ids != own)
    if len(free) > k:
        s = scores[free]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        free = free[s >= edge]
    return free[np.lexsort((ids[free], -scores[free]))][:k]


def _searcher(held, k: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, queries = held.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                sizes = np.array([len(x) for x in part.w], np.int64)
                post = Postings(np.concatenate([np.asarray(x, np.int64) for x in part.w]), np.concatenate([[0], np.cumsum(sizes)]))
                ids = part.id.to_numpy(np.int64)
                for q in range(0, len(qids), block):
                    scores = accumulate(queries[q : q + block], post)
                    for i, own in enumerate(qids[q : q + block]):
                        top = select(scores[i], ids, own, k)
                        old_ids, old = best[q + i]
                        held_ids, found = np.concatenate([old_ids, ids[top]]), np.concatenate([old, scores[i][top]])
                        order = np.lexsort((held_ids, -found))[:k]
                        best[q + i] = held_ids[order], found[order]
        for q in range(0, len(qids), block):
            some = best[q : q + block]
            if any(len(x[0]) for x in some):
                yield pd.DataFrame({"query_id": np.repeat(np.array(qids[q : q + block], np.int64), [len(x[0]) for x in some]), "vec_id": np.concatenate([x[0] for x in some]), "score": np.concatenate([x[1] for x in some])})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query id the k candidates of highest inner product.

    Both inputs are (id, w) as `quantised` makes them; other columns are not read. Ties go to smaller ids; rows of
    the query's own id are no candidates; a query with fewer candidates gets all of them. A repeated query id is
    one query, with the least of its vectors; repeated candidate rows all count. Components beyond the shorter
    vector count as 0; weights may be negative, and a sum beyond 64 bits wraps. Rows without id or vector take no
    part. Empty tables give no rows."""
    spark = candidates.sparkSession
    some = "id is not null and w is not null"
    asked = shared.cut(queries.filter(some).groupBy("id").agg(F.min("w").alias("w")))
    size = asked.agg(F.sum(8 * F.size("w") + 64)).collect()[0][0] or 0
    n_passes = max(1, -(-size // pass_bytes))
    numbered = asked.withColumn("pass", F.pmod(F.xxhash64("id"), F.lit(n_passes)))
    schema = "query_id long, vec_id long, score long"
    out = None
    for b in range(n_passes):
        rows = numbered.filter(F.col("pass") == b).select("id", "w").toPandas()  # about `pass_bytes`
        held = spark.sparkContext.broadcast((rows.id.to_list(), [np.asarray(x, np.int64) for x in rows.w]))
        found = candidates.filter(some).select("id", "w").mapInPandas(_searcher(held, k, block), schema)
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        merged = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        merged = merged.select("query_id", "rank", "vec_id", "score")
        if n_passes > 1:
            merged = shared.cut(merged)
            held.unpersist()
        out = merged if out is None else out.unionByName(merged)
    return out

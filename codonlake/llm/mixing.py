"""Mixing sources to target weights by Pfair scheduling.

A source is a task whose weight is its target share, a block of its documents a subtask: block i (from 0) of
a source of weight w is released at slot floor(i / w) and due at slot ceil((i + 1) / w). Each slot goes to
the released block with the earliest deadline. The weights sum to 1, so every block meets its deadline and
each source is less than one block from its ideal share at every slot.

Weights are taken exactly, as integers in proportion to them, so nothing is rounded however long the schedule
is. A source of weight 0 waits until the others are done. When a source has no blocks left, a new phase
begins in which the remaining sources share the slots in proportion to their weights. The driver runs through
the slots once and keeps only the state (blocks done of each source) at the start of every `EPOCH` slots; from
those the executors work out the slots again, each epoch by itself. A source's documents are numbered without
gathering them: they are dealt to buckets by hash, each of about `BUCKET` rows, buckets are counted, running
totals of the counts give each bucket its start, and rows are numbered inside buckets. So a hot source has
many buckets. A bucket gets the slots of its blocks as one array, so documents are joined by bucket.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared

#: Documents of a block, rows of a bucket, slots of an epoch; the columns that a schedule adds.
BLOCK_DOCS, BUCKET, EPOCH = 16, 4000, 8192
COLUMNS = ("block", "slot", "release", "deadline", "position")


def exact(weights: list[float]) -> list[int]:
    """Integers in exactly the same proportion; weights under 0 count as 0."""
    parts = [max(Fraction(w), Fraction(0)) for w in weights]
    scale = lcm(*[x.denominator for x in parts])
    return [int(x * scale) for x in parts]


class Schedule:
    """Iterates over (source's number, block, slot, release, deadline), from a state on."""

    def __init__(self, blocks: list[int], weights: list[int], state: tuple | None = None):
        none = [0] * len(blocks)
        self.blocks, self.weights = blocks, weights
        # next slot; first slot of the phase; blocks done before the phase, and in all
        self.slot, self.start, first, done = state or (0, 0, none, none)
        self.first, self.done = list(first), list(done)

    def state(self) -> tuple[int, int, list[int], list[int]]:
        return self.slot, self.start, list(self.first), list(self.done)

    def __iter__(self) -> Iterator[tuple[int, int, int, int, int]]:
        while left := [k for k, n in enumerate(self.blocks) if self.done[k] < n]:
            weight = {k: self.weights[k] for k in left if self.weights[k]} or dict.fromkeys(left, 1)
            total = sum(weight.values())
            # each source's next block waits for its release or is ready, by deadline
            waiting = [((self.done[k] - self.first[k]) * total // w, k) for k, w in weight.items()]
            heapq.heapify(waiting)
            ready: list[tuple[int, int, int]] = []
            over = False
            while not over:
                while waiting and waiting[0][0] <= self.slot - self.start:
                    release, k = heapq.heappop(waiting)
                    heapq.heappush(ready, (-(-(self.done[k] - self.first[k] + 1) * total // weight[k]), k, release))
                due, k, release = heapq.heappop(ready)
                out = k, self.done[k], self.slot, self.start + release, self.start + due
                self.done[k] += 1
                self.slot += 1
                if over := self.done[k] == self.blocks[k]:
                    self.start, self.first = self.slot, list(self.done)
                else:
                    heapq.heappush(waiting, ((self.done[k] - self.first[k]) * total // weight[k], k))
                yield out


def epochs(blocks: list[int], weights: list[int], slots: int) -> list[tuple]:
    """The states at the start of every `slots` slots."""
    at, out, n = Schedule(blocks, weights), [], sum(blocks)
    steps = iter(at)
    while at.slot < n:
        out.append(at.state())
        if at.slot + slots >= n:
            break
        deque(islice(steps, slots), maxlen=0)
    return out


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None, alpha: float, block_docs: int) -> DataFrame:
    """row (all columns, packed) and the columns of the schedule."""
    spark = docs.sparkSession
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    name = F.coalesce(F.concat(F.lit("s:"), F.col(f"`{source_col}`").cast("string")), F.lit("null"))
    # rows without id are told apart by their other columns
    other = F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.lit(13))
    tie = F.when(F.col(f"`{id_col}`").isNull(), other).otherwise(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(11)))
    rows = shared.packed(docs, id=F.col(f"`{id_col}`"), s=name, h=tie)
    counts = {r.s: r.n for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = {s: float((weights or {}).get(s[2:], n**alpha)) for s, n in counts.items()}
    names = sorted(counts)
    every, held = EPOCH, spark.sparkContext.broadcast((names, [-(-counts[s] // block_docs) for s in names], exact([target[s] for s in names])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, blocks, weights = held.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = pd.DataFrame(islice(Schedule(blocks, weights, (int(r.slot), int(r.start), r.first.tolist(), r.done.tolist())), every), columns=["k", "block", "slot", "release", "due"])
                yield out.assign(s=[names[k] for k in out.k])[["s", "block", "slot", "release", "due"]]

    states = spark.createDataFrame(epochs(*held.value[1:], every), "slot long, start long, first array<long>, done array<long>")
    table = states.mapInPandas(run, "s string, block long, slot long, release long, due long")
    buckets = spark.createDataFrame([(s, max(1, -(-n // BUCKET))) for s, n in counts.items()], "s string, nb long")
    dealt = rows.join(F.broadcast(buckets), "s").withColumn("b", F.pmod(F.col("h"), F.col("nb")))
    starts = dealt.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # one row for each `BUCKET` rows
    starts = starts.select("s", "b", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("from"))
    parts = starts.select("s", "b", "from", F.explode(F.expr(f"sequence(`from` div {block_docs}, (`from` + n - 1) div {block_docs})")).alias("block"))
    cells = F.sort_array(F.collect_list(F.struct("block", "slot", "release", "due"))).alias("cells")
    starts = parts.join(table, ["s", "block"]).groupBy("s", "b").agg(F.min("from").alias("from"), cells)
    inner = W.partitionBy("s", "b").orderBy("h", "id")
    numbered = dealt.withColumn("rn", F.row_number().over(inner) - 1).join(starts, ["s", "b"]).withColumn("at", F.col("from") + F.col("rn"))
    numbered = numbered.withColumn("block", F.expr(f"at div {block_docs}")).withColumn("cell", F.expr(f"cells[cast(block - `from` div {block_docs} as int)]"))
    found = ["block", F.col("cell.slot").alias("slot"), F.col("cell.release").alias("release"), F.col("cell.due").alias("deadline"), (F.col("cell.slot") * block_docs + F.col("at") % block_docs).alias("position")]
    return numbered.select("row", *found)


def schedule(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, block_docs: int = BLOCK_DOCS, names: tuple[str, ...] = COLUMNS
) -> DataFrame:
    """The rows with block (number in the source), slot, release, deadline (in slots) and position (order of the mix), or other names for them.

    weights: target share of each source, any positive scale; sources without one, and all where it is
    None, get rows ** alpha. A null source is a source of its own. Every row stays, repeated rows and rows
    without id included; ties inside a source are broken by a hash of the id (of the other columns where it is
    null). Texts are only carried. An empty table gives no rows. A result column whose name docs has gets an
    underscore more; other columns may have any names. The sources' names and counts are the only thing the driver gathers."""
    names = shared.free_names(docs, *names)
    out = _placed(docs, id_col, source_col, weights, alpha, block_docs)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(COLUMNS, names, strict=True)])


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents' columns, whatever their names, in the order of the mix, dealt to partitions by ranges of it. Otherwise as `schedule`."""
    out = _placed(docs, id_col, source_col, weights, alpha, block_docs).select("row", "position")
    ordered = out.repartitionByRange(shared.partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return shared.unpacked(ordered, docs.columns)

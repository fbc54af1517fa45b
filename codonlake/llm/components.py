"""Connected components of a graph given as rows (a, b), by repeated joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import shared


def components(edges: DataFrame, scratch: shared.Scratch, name: str) -> DataFrame:
    """node, label for every node of an edge: the least node that it is connected to.

    In each round a node takes the least label among its neighbours', then the label of its label, so the
    number of rounds is about the logarithm of the longest path. The head of a large group is the end of very
    many edges and the label of very many nodes, so those joins take hot keys apart. Joins shuffle at every size, so that
    small inputs tell what large ones need. The result is kept in
    the scratch folder under the name; what the rounds need is dropped."""
    turned = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(f"{name}-edges", turned.filter("a <> b").distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved"))
    labels, k = scratch.keep(f"{name}-0", first), 0
    while True:
        near = shared.join_unique(both, labels.select(F.col("node").alias("b"), "label"), "b", "a", "inner", broadcast=False)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = scratch.keep(f"{name}-step", labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = shared.join_unique(stepped, jump, "label", "node", "inner", broadcast=False).select("node", F.least("label", "far").alias("label"), (F.col("old") > F.least("label", "far")).alias("moved"))
        labels = scratch.keep(f"{name}-{k + 1}", jumped)
        done = labels.filter("moved").isEmpty()
        scratch.drop(f"{name}-{k}", f"{name}-step", *([f"{name}-edges"] if done else []))
        k += 1
        if done:
            return labels.select("node", "label")

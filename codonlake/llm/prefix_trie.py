"""A trie of the turns that conversations begin with, and totals over its subtrees by peeling leaves.

Turns become digests before anything is shuffled, so texts move once at most. A prefix is known by two 64-bit sums (exclusive
or) of hashes of its turns at their places. Equal prefixes of all conversations are one node.

Each node belongs to one of its members, the one with the least hash of its id, so that what belongs to a conversation is
one run of nodes down its own path, and the trie is a tree of runs. On any path from the root owners change only where the
least of the hashes left does, about the logarithm of the number of conversations times, however long the conversations
and whatever the order of ids. Totals travel along this tree: a run holds a counter of the runs that hang on it and
haven't finished; a run whose counter is zero sends the totals of its subtrees to the run it hangs on, whose
counter falls, until only the run of the root finishes. Rounds are as many as changes of owner; each one reads what is
unfinished. Totals of the nodes inside a run are sums from its bottom up, of its own nodes and of what was sent to each.

Conversations of any length are dealt by ranges of (conversation, place); the few that lie in several ranges get what comes
before or after a range from a small table, so no task or window needs a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared

#: Consecutive ids that are joined to one text before members of a node are put in order.
BLOCK_BITS = 12
_KEY = ("depth", "a", "b")


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, digest (of role and text), words. A null role or text counts as empty; rows without conversation take no part."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    known = rows.filter(F.col(f"`{conv_col}`").isNotNull())
    return known.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), words.alias("words"))


def _dealt(scratch: shared.Scratch, name: str, rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt by ranges of the order and kept, with the range's number."""
    n = shared.partitions(scratch.spark)
    return scratch.keep(name, rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def _several(dealt: DataFrame, family: str) -> DataFrame:
    """The families that lie in several ranges: they are first or last in each, so there are at most as many as ranges."""
    edges = dealt.groupBy("_range").agg(F.min(family).alias("lo"), F.max(family).alias("hi"))
    found = edges.select("_range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(family))
    return found.groupBy(family).agg(F.count(F.lit(1)).alias("_n"), F.max("_range").alias("_final")).filter("_n > 1").drop("_n")


def _with_others(dealt: DataFrame, rows: DataFrame, family: str, totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """rows with what other ranges of their family hold: totals of each range, then the windows `over` those.

    The joined table has at most two rows for each range."""
    several = F.broadcast(_several(dealt, family))
    each = rows.join(several, family).groupBy(family, "_range").agg(F.first("_final").alias("_final"), *[c.alias(n) for n, c in totals.items()])
    each = each.select(family, "_range", "_final", *[c.alias(n) for n, c in over.items()])
    return rows.join(F.broadcast(each), [family, "_range"], "left")


def _before(family: str) -> W:
    return W.partitionBy(family).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)


def _after(family: str) -> W:
    return W.partitionBy(family).orderBy("_range").rowsBetween(1, W.unboundedFollowing)


def _numbered(dealt: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The place of each row in its conversation, from 0."""
    inner = dealt.withColumn("_inner", F.row_number().over(W.partitionBy("conv", "_range").orderBy(*order)))
    out = _with_others(dealt, inner, "conv", {"_rows": F.count(F.lit(1))}, {"_earlier": F.sum("_rows").over(_before("conv"))})
    return out.withColumn(name, F.col("_inner") + F.coalesce("_earlier", F.lit(0)) - 1).drop("_inner", "_earlier")


def placed(scratch: shared.Scratch, rows: DataFrame) -> DataFrame:
    """conv, pos, digest, words: the turns in order, from 0. Null turns come first; equal ones go by their digest."""
    dealt = _dealt(scratch, "turns", rows, "conv", "turn", "digest")
    out = _numbered(dealt, [F.asc_nulls_first("turn"), F.asc("digest")], "pos")
    return scratch.keep("placed", out.select("conv", F.col("pos").cast("long").alias("pos"), "digest", "words"))


def beginnings(turns_placed: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, part, pos, digest, words: what conversations begin with, before turns of their own.

    convs (conv, head: whose turns it begins with, take: how many) names each once. Part -1 is the empty beginning of each,
    part 0 the first `take` turns of its head, or all where there are fewer."""
    first = turns_placed.filter(F.col("pos") < F.lit(convs.agg(F.max("take")).first()[0] or 0)).withColumnRenamed("conv", "head")
    heads = convs.join(first, "head").filter("pos < take").select("conv", F.lit(0).alias("part"), "pos", "digest", "words")
    return heads.unionByName(convs.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")))


def _prefixes(scratch: shared.Scratch, rows: DataFrame) -> DataFrame:
    """conv, depth, a, b (the prefix), pa, pb (the one before it), words of its last turn, last (whether the conversation ends there)."""
    dealt = _dealt(scratch, "rows", rows, "conv", "part", "pos")
    deep = _numbered(dealt, [F.asc("part"), F.asc("pos")], "depth")
    mark = lambda salt: F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(salt), "depth", "digest"))
    deep = deep.select("conv", "_range", "depth", "words", mark(11).alias("x"), mark(29).alias("y"))
    own = W.partitionBy("conv", "_range").orderBy("depth")
    up_to = own.rowsBetween(W.unboundedPreceding, 0)
    inner = deep.withColumn("ia", F.bit_xor("x").over(up_to)).withColumn("ib", F.bit_xor("y").over(up_to)).withColumn("_next", F.lead("depth").over(own))
    # totals of ranges come from the rows before the windows
    each = deep.join(F.broadcast(_several(dealt, "conv")), "conv").groupBy("conv", "_range").agg(F.first("_final").alias("_final"), F.bit_xor("x").alias("rx"), F.bit_xor("y").alias("ry"))
    each = each.select("conv", "_range", "_final", F.bit_xor("rx").over(_before("conv")).alias("ba"), F.bit_xor("ry").over(_before("conv")).alias("bb"))
    out = inner.join(F.broadcast(each), ["conv", "_range"], "left")
    a, b = (F.col(i).bitwiseXOR(F.coalesce(o, F.lit(0))) for i, o in (("ia", "ba"), ("ib", "bb")))
    last = F.col("_next").isNull() & F.coalesce(F.col("_range") == F.col("_final"), F.lit(True))
    return scratch.keep("prefixes", out.select("conv", F.col("depth").cast("long").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"), "words", last.alias("last")))


def _hashed_lists(parts: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of texts that are joined by commas in the order of their blocks, one at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def row(keys: list, digests: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array(digests, pa.string())], names=[*_KEY, "ends_sha256"])

        for batch in batches:
            keys, digests = [], []
            for d, a, b, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (d, a, b) == at:
                    held.update(b",")
                else:
                    if held is not None:
                        keys.append(at)
                        digests.append(held.hexdigest())
                    at, held = (d, a, b), hashlib.sha256()
                held.update(text.encode())
            yield row(keys, digests)
        if held is not None:
            yield row([at], [held.hexdigest()])

    dealt = parts.select(*_KEY, "block", "ids").repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.mapInArrow(work, "depth long, a long, b long, ends_sha256 string")


def _ends(prefixes: DataFrame) -> DataFrame:
    """The hash of the ids that end at each node, in order of numbers. Ids that lie close together are joined before the shuffle by node."""
    ended = prefixes.filter("last").select(*_KEY, "conv", F.shiftright("conv", BLOCK_BITS).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    return _hashed_lists(ended.groupBy(*_KEY, "block").agg(ids.alias("ids")))


def peeled(scratch: shared.Scratch, runs: DataFrame) -> DataFrame:
    """run, up, at, saved, leaves of the whole subtree of each run.

    runs: run, up (the run it hangs on; null: none), at (where), saved and leaves of its own. What hangs on a run must finish
    before it does."""
    waits = runs.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("left")).withColumnRenamed("up", "run")
    active = scratch.keep("active-0", runs.join(waits, "run", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long"))))
    k, finished = 0, []
    while not active.isEmpty():
        ready = scratch.keep(f"done-{k}", active.filter("left = 0").drop("left"))
        finished.append(f"{scratch.path}/done-{k}")
        sent = ready.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("_n"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves")).withColumnRenamed("up", "run")
        rest = active.filter("left > 0").join(sent, "run", "left")
        add = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
        active = scratch.keep(f"active-{k + 1}", rest.select("run", "up", "at", add("saved", "_saved"), add("leaves", "_leaves"), (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left")))
        scratch.drop(f"active-{k}")
        k += 1
    return scratch.spark.read.schema(runs.schema).parquet(*finished) if finished else runs


def trie(scratch: shared.Scratch, rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    rows (conv, part, pos, digest, words) are conversations in the order of part and pos, with one row of part -1 for each, also
    for those without turns. conv_id and depth name a node: the least of its members, and its number of turns. Repeated
    turns are turns; conversations that are alike share their nodes; no rows give no nodes."""
    prefixes = _prefixes(scratch, rows)
    one = prefixes.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.min(F.struct(F.xxhash64("conv").alias("h"), "conv")).alias("o"), F.count(F.lit(1)).alias("n_convs"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"),
    )
    nodes = scratch.keep("nodes", one.select(*_KEY, "pa", "pb", "conv_id", F.col("o.conv").alias("run"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    ends = scratch.keep("ends", _ends(prefixes))
    scratch.only("nodes", "ends")

    runs = nodes.groupBy("run").agg(F.min(F.struct("depth", "pa", "pb")).alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
    runs = runs.select("run", F.col("top.depth").alias("depth"), "bottom", "saved", F.when(F.col("top.depth") > 0, F.struct((F.col("top.depth") - 1).alias("depth"), F.col("top.pa").alias("a"), F.col("top.pb").alias("b"))).alias("key"))
    above = nodes.select(F.struct(*_KEY).alias("key"), F.col("run").alias("up"), F.col("conv_id").alias("up_conv"))
    runs = scratch.keep("runs", shared.join_unique(runs, above, "key", "run", "left", broadcast=False).withColumn("at", F.when(F.col("up").isNotNull(), F.col("depth") - 1)).drop("key"))
    hung = runs.filter("up is not null").select(F.col("up").alias("run"), F.col("at").alias("bottom")).distinct().withColumn("_hung", F.lit(True))
    own = runs.join(hung, ["run", "bottom"], "left").select("run", "up", "at", "saved", F.when(F.col("_hung"), 0).otherwise(1).cast("long").alias("leaves"))
    totals = peeled(scratch, own)

    nothing = F.lit(None).cast("long")
    marks = totals.filter("up is not null").select(F.col("up").alias("run"), F.col("at").alias("depth"), F.lit(1).alias("hung"), F.col("saved").alias("in_saved"), F.col("leaves").alias("in_leaves"), nothing.alias("up_conv"), F.lit(0).alias("ends_run"))
    marks = marks.unionByName(runs.select("run", "depth", F.lit(0).alias("hung"), F.lit(0).alias("in_saved"), F.lit(0).alias("in_leaves"), "up_conv", F.lit(0).alias("ends_run")))
    marks = marks.unionByName(runs.select("run", F.col("bottom").alias("depth"), F.lit(0).alias("hung"), F.lit(0).alias("in_saved"), F.lit(0).alias("in_leaves"), nothing.alias("up_conv"), F.lit(1).alias("ends_run")))
    marks = marks.groupBy("run", "depth").agg(*[F.sum(c).alias(c) for c in ("hung", "in_saved", "in_leaves")], F.max("up_conv").alias("up_conv"), F.max("ends_run").alias("ends_run"))
    whole = nodes.join(ends, list(_KEY), "left").join(marks, ["run", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_children = zero("hung") + 1 - zero("ends_run")
    whole = whole.select(
        "run", "depth", "conv_id", "n_convs", "up_conv", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), n_children.cast("long").alias("n_children"),
        (F.col("saved") + zero("in_saved")).alias("s"), (zero("in_leaves") + F.when(n_children == 0, 1).otherwise(0)).alias("v"),
    )
    dealt = _dealt(scratch, "whole", whole, "run", "depth")
    down = W.partitionBy("run", "_range").orderBy("depth")
    up = W.partitionBy("run", "_range").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    inner = dealt.withColumn("is", F.sum("s").over(up)).withColumn("iv", F.sum("v").over(up)).withColumn("_parent", F.lag("conv_id").over(down))
    each = dealt.join(F.broadcast(_several(dealt, "run")), "run").groupBy("run", "_range").agg(F.sum("s").alias("rs"), F.sum("v").alias("rv"), F.max_by("conv_id", "depth").alias("rc"))
    each = each.select("run", "_range", F.sum("rs").over(_after("run")).alias("os"), F.sum("rv").over(_after("run")).alias("ov"), F.lag("rc").over(W.partitionBy("run").orderBy("_range")).alias("oc"))
    out = inner.join(F.broadcast(each), ["run", "_range"], "left")
    return out.select(
        "conv_id", "depth", F.coalesce("up_conv", "_parent", "oc").alias("parent_conv_id"), "n_convs", "n_children", (F.col("iv") + zero("ov")).cast("long").alias("n_leaves"),
        (F.col("is") + zero("os")).cast("long").alias("saved_tokens"), "ends_sha256",
    )


def prefixes_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they are. Nulls, ties and repeats as in `turns`, `placed` and `trie`; other columns aren't read, whatever their names."""
    scratch = shared.Scratch(rows.sparkSession)
    own = placed(scratch, turns(rows, conv_col, turn_col, role_col, text_col))
    convs = own.select("conv").distinct().select("conv", F.col("conv").alias("head"), F.lit(0).alias("take"))
    return trie(scratch, beginnings(own, convs).unionByName(own.withColumn("part", F.lit(1))))


def rebuilt_report(rows: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations that begin with up to `most` - 1 turns of the first of their group of ids (`crc32` of the id tells how many)."""
    scratch = shared.Scratch(rows.sparkSession)
    own = placed(scratch, turns(rows))
    take = F.crc32(F.col("conv").cast("string")) % most
    convs = own.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("head"), take.alias("take"))
    rest = own.filter(F.col("pos") >= take).withColumn("part", F.lit(1))
    return trie(scratch, beginnings(own, convs).unionByName(rest))

"""N-gram Jaccard join by T-occurrence search, and the groups that its links make.

A document is the set of its distinct word shingles. Two documents link when their sets' Jaccard similarity
is at least a threshold, and groups are connected by links.

Texts with equal sets are one class. Classes that can link must meet in a task: with shingles in the order of
their hashes, a linked pair has its R least common shingles among the first n - ceil(t n) + R shingles of
each set of n. So each class posts that many of its shingles; a class with fewer posted shingles in common
with other classes than R has no links at all, and the others that share a posted shingle are put together
with the least class that has it, their centre. A class needs not go wherever one of its shingles leads: if
both classes of a pair leave out fewer than half of R of theirs, one that both keep remains. So each leaves
out frequent shingles (of passages that many documents share) and then the centres that it shares least
with, as far as that allowance goes. That is exact for any data.

In a task, the sets are inverted, and T-occurrence searches by DivideSkip find the links: a query's shingles
are lists; the shorter ones are merged and counted (by one sort of them all, which gives what a heap gives),
which leaves candidates short of the needed overlap by at
most the number of lists set aside, and the long ones are probed for them by binary search. Only groups are
asked for, so a set is a query only as long as it is outside the largest group found so far: any link
between two groups has an end outside it. So a group of near copies takes a few searches.

Tasks are dealt by shingles, and a worker holds one part of a centre at a time: a larger centre's classes are
dealt to several parts, and where they don't come out as one group, every pair of those parts is searched too.
All intermediate tables are Parquet in the shared folder and dropped as soon as nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.llm import shared
from codonlake.llm.components import components
from codonlake.llm.textarrays import Hasher, chunks, mix

#: Shingles of a task, about; posted shingles from the percentage of a set's size, beyond what a link may lack;
#: documents with a posted shingle from which on it counts as frequent.
TASK_SHINGLES, EXTRA, FREQUENT = 1_000_000, 10, 64
#: Frequent shingles that a join looks up in a broadcast instead of a shuffle.
HOT_SIGS = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; the whole text as one where it has fewer words."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]  # lowers A-Z only
        codes = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        inside = ~_SPACE[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        h = Hasher(codes).of(start, end)
        base = np.cumsum([1, *[len(x) + 1 for x in raw]])
        at = np.searchsorted(start, base)
        with np.errstate(over="ignore"):
            runs = h
            for j in range(1, k):
                runs = mix(runs[: len(h) - j] * _M + h[j:]) if len(h) > j else h[:0]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i >= k:
                    out.append(np.unique(runs[i : j - k + 1]))
                elif j > i:
                    x = np.uint64(j - i)
                    for w in h[i:j]:
                        x = mix(np.array([x * _M + w], np.uint64))[0]
                    out.append(np.array([x], np.uint64))
                else:
                    out.append(h[:0])
    return out


def set_class(s: np.ndarray) -> int:
    """One 64-bit number for a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def posted_count(n: int, percent: int) -> int:
    """Shingles that a set of n posts."""
    return min(n, n - -(-percent * n // 100) + 1 + EXTRA * n // 100)


def common_posted(n: int, percent: int) -> int:
    """Posted shingles that a set of n shares at least with any set it links to, which has ceil(t n) shingles or more."""
    return 1 + EXTRA * -(-percent * n // 100) // 100


def needed(a, b, percent: int):
    """Common shingles that sets of sizes a and b need: the least i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class Inverted:
    """Inverted lists over some sets, and DivideSkip searches in them."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(flat, kind="stable")  # lists come out sorted by set
        flat = flat[order]
        self.post = owner[order]
        first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
        self.key, self.at = flat[first], np.append(first, len(flat))

    def search(self, q: int) -> np.ndarray:
        """The other sets that link with set q."""
        s = self.sets[q]
        k = np.searchsorted(self.key, s)
        a, b = self.at[k], self.at[k + 1]
        order = np.argsort(b - a)
        n = len(s)
        least = int(needed(n, -(-self.percent * n // 100), self.percent))
        lengths = (b - a)[order]
        # the longest lists are set aside, fewer than the least overlap and only where they are long
        aside = min(least - 1, int(least / (1 + 0.5 * np.log2(1 + lengths[-1]))), int((lengths > 8).sum()))
        short, long = order[: n - aside], order[n - aside :]
        count_of = (b - a)[short]
        upto = np.cumsum(count_of)
        merged = np.sort(self.post[np.arange(upto[-1]) + np.repeat(a[short] - upto + count_of, count_of)], kind="stable")
        first = np.concatenate([[0], np.flatnonzero(merged[1:] != merged[:-1]) + 1])
        cand, count = merged[first], np.diff(np.append(first, len(merged)))
        keep = (cand != q) & (count + aside >= needed(n, self.size[cand], self.percent)) & (self.size[cand] * 100 >= self.percent * n) & (n * 100 >= self.percent * self.size[cand])
        cand, count = cand[keep], count[keep]
        for i in long:
            if not len(cand):
                break
            listed = self.post[a[i] : b[i]]
            p = np.minimum(np.searchsorted(listed, cand), len(listed) - 1)
            count = count + (listed[p] == cand)
        return cand[count >= needed(n, self.size[cand], self.percent)]


def groups(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of its group. known: numbers of groups that are known already."""
    n = len(sets)
    root = np.arange(n)
    if known is not None:
        _, at, code = np.unique(known, return_index=True, return_inverse=True)
        root = at[code]
    if n < 2 or len(np.unique(root)) < 2:
        return root
    index, todo = Inverted(sets, percent), np.ones(n, bool)
    while True:
        sizes = np.bincount(root, minlength=n)
        out = np.flatnonzero(todo & (root != sizes.argmax()))
        if sizes.max() == 1 and todo.all():
            out = np.arange(n)
        if not len(out) or sizes.max() == n:
            return root
        q = out[0]
        todo[q] = False
        met = np.unique(root[np.append(index.search(q), q)])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]


def _profile(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.text]
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                yield pd.DataFrame({
                    "id": batch.id.iloc[a:b].to_numpy(), "named": batch.named.iloc[a:b].to_numpy(), "key": batch.key.iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "node": [set_class(s) for s in sets],
                    "posted": [s[: posted_count(len(s), percent)].view(np.int64) for s in sets],
                })

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.text.to_list()
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                yield pd.DataFrame({"node": batch.node.iloc[a:b].to_numpy(), "shingles": [s.tobytes() for s in sets]})

    return run


def _linked(percent: int):
    """Edges from rows (centre, part, node, label, shingles) that come sorted by centre, part and node: one part is held at a time."""

    def edges(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        g = held[0] if len(held) == 1 else pd.concat(held)
        nodes = g.node.to_numpy()
        once = np.append(True, nodes[1:] != nodes[:-1])  # a node that comes twice stands beside itself
        nodes = nodes[once]
        root = groups([np.frombuffer(x, np.uint64) for x in g.shingles[once]], percent, g.label.to_numpy()[once])
        far = root != np.arange(len(root))
        return nodes[far], nodes[root[far]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, found = [], None, []
        for batch in batches:
            centre, part = batch.centre.to_numpy(), batch.part.to_numpy()
            bounds = [0, *(np.flatnonzero((centre[1:] != centre[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(batch)]
            for i, j in pairwise(bounds):
                if i == j:
                    continue
                if held and at != (centre[i], part[i]):
                    found.append(edges(held))
                    held = []
                at = centre[i], part[i]
                held.append(batch.iloc[i:j])
        if held:
            found.append(edges(held))
        if found:
            yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return run


def _search(members: DataFrame, sets: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Edges (a, b) from tasks: members (centre, part, node, n, label) with the sets joined on; small parts share a task."""
    total = members.agg(F.sum("n")).collect()[0][0] or 0
    tasks = max(shared.partitions(members.sparkSession), total // task_shingles)
    ready = members.select("centre", "part", "node", "label").join(sets.hint("merge"), "node").repartition(tasks, "centre", "part").sortWithinPartitions("centre", "part", "node")
    return ready.mapInPandas(_linked(percent), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """id, n_shingles, component_id, component_rows for every row.

    Words are what stands between ASCII white space, with A-Z lower-cased. Texts that are null, empty or
    blank have no shingles, and each is a group of its own. Rows with equal ids take part each with its own
    text and are returned each; a null id takes part but is no candidate for a component_id, and a group of
    null ids has a null one. Ties don't arise: a group's name is its least id. component_rows is the number of
    rows of the group. A text is worked on whole, however long. An empty table gives no rows; other columns
    are not read, whatever their names."""
    spark = docs.sparkSession
    scratch = shared.Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    whole = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "key", "text")  # pandas has no null in integers
    base = whole.mapInPandas(_profile(k, percent), "id long, named boolean, key long, n long, node long, posted array<long>")
    base = scratch.keep("base", base.withColumn("id", F.when(F.col("named"), F.col("id"))).drop("named"))
    ids = scratch.keep("ids", base.select("id", "n", "node"))
    # one class for each set of shingles, so copies go no further; blank texts are in none
    one = base.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.any_value("posted").alias("posted"))
    classes = scratch.keep("classes", one)
    scratch.drop("base")
    n_classes = classes.count()
    postings = classes.select("node", F.explode("posted").alias("sig"))
    least = f"1 + {EXTRA} * (({percent} * n + 99) div 100) div 100"

    def meet(name: str, posts: DataFrame, label: str) -> DataFrame:
        """Shared shingles `name`-shares, the classes that may link to one of another label `name`-able, and pairs (node, centre) of them.

        A link between two labels shares only shingles that both labels post, so only those count. Repeats of a
        posting count again: counts are at least the true ones, so nothing is lost."""
        found = [F.min("node").alias("centre"), F.min(label).alias("lo"), F.max(label).alias("hi")] if label != "node" else [F.min("node").alias("lo"), F.max("node").alias("hi")]
        shares = posts.groupBy("sig").agg(*found, F.count(F.lit(1)).alias("rows")).filter("lo <> hi")
        shares = scratch.keep(f"{name}-shares", shares.select("sig", F.col("centre" if label != "node" else "lo").alias("centre"), "rows"))
        # few shingles are in a thousandth of the classes: a class posts a hundred or so
        hot = shares.filter(F.col("rows") >= max(FREQUENT, n_classes // 1000)).orderBy(F.desc("rows"), "sig").limit(HOT_SIGS).select("sig")
        shares = shares.select("sig", "centre", (F.col("rows") > FREQUENT).cast("int").alias("frequent"))
        met = shared.join_unique(shared.sieve(posts.select("node", "sig"), shares, "sig"), shares, "sig", "node", "inner", hot, broadcast=False)
        met = scratch.keep(f"{name}-met", met.groupBy("node", "centre", "frequent").agg(F.count(F.lit(1)).alias("shared")))
        totals = classes.select("node", "key", "n").join(met.groupBy("node").agg(F.sum("shared").alias("all_shared")).hint("merge"), "node").withColumn("least", F.expr(least))
        able = scratch.keep(f"{name}-able", totals.filter("all_shared >= least").select("node", "key", "n", "least"))
        # a class has at most one row for each of its posted shingles
        w = W.partitionBy("node").orderBy(F.desc("frequent"), "shared", "centre").rowsBetween(W.unboundedPreceding, 0)
        pairs = met.filter("node <> centre").join(able.select("node", "least").hint("merge"), "node").withColumn("left_out", F.sum("shared").over(w))
        pairs = scratch.keep(f"{name}-pairs", pairs.filter("left_out > (least - 1) div 2").groupBy("node", "centre").agg(F.sum("shared").alias("shared")))
        scratch.drop(f"{name}-met")
        return pairs

    pairs = meet("first", postings, "node")
    shares, chosen = (spark.read.parquet(f"{scratch.path}/first-{x}") for x in ("shares", "able"))
    texts = shared.sieve(rows.filter("text is not null").select("key", "text"), chosen, "key").groupBy("key").agg(F.any_value("text").alias("text")).join(chosen.select("key", "node").hint("merge"), "key")
    sets = scratch.keep("sets", texts.select("node", "text").mapInPandas(_sets(k), "node long, shingles binary"))
    sizes = chosen.select("node", "n")

    def members(of: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(centre, parts, part, node, n, label): each node of a centre in one part of bounded size, the centre in every part."""
        sized = of.join(sizes.hint("merge"), "node")
        parts = sized.groupBy("centre").agg((F.floor(F.sum("n") / task_shingles) + 1).alias("parts"))
        own = sized.join(parts.hint("merge"), "centre").select("centre", "parts", F.pmod(F.xxhash64("node", F.lit(3)), "parts").alias("part"), "node", "n")
        heads = parts.select("centre", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
        # a centre that has no links itself only brings the others together
        heads = heads.join(sizes.hint("merge"), "node").select("centre", "parts", "part", "node", "n")
        return labelled(own.union(heads), labels)

    def labelled(m: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return m.withColumn("label", F.col("node"))
        return m.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))

    # each node with the centre that it shares most with: this finds most groups
    best = scratch.keep("best", members(pairs.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre")), None))
    edges = scratch.keep("edges-1", _search(best, sets, percent, task_shingles))
    labels = components(edges, scratch, "labels-1")
    scratch.drop("best", "first-pairs")

    def unlike(m: DataFrame) -> DataFrame:
        """The members of centres that have more than one group."""
        mixed = m.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("centre")
        return m.join(mixed.hint("merge"), "centre", "left_semi")

    # what may still link across those groups, with all centres that it needs
    posts = shared.sieve(postings, shares, "sig").join(chosen.select("node").hint("merge"), "node", "left_semi")
    pairs = meet("second", labelled(posts, labels), "label")
    rest = scratch.keep("rest", unlike(members(pairs.select("node", "centre"), labels)))
    scratch.drop("first-shares", "second-shares", "second-pairs", "second-able")
    if not rest.isEmpty():
        edges = scratch.keep("edges-2", edges.union(_search(rest, sets, percent, task_shingles)))
        labels = components(edges, scratch, "labels-2")
        # centres dealt to several parts: all pairs of parts that aren't one group, since a link can be between any two of their members
        many = unlike(labelled(rest.filter("parts > 1").drop("label"), labels))
        twos = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part"))))
        many = scratch.keep("many", many.select("centre", twos.alias("part"), "node", "n", "label"))
        if not many.isEmpty():
            edges = scratch.keep("edges-3", edges.union(_search(many, sets, percent, task_shingles)))
            labels = components(edges, scratch, "labels-3")

    # names are given to classes, and only then to rows; a class of one row without links needs none
    named = classes.select("node", "id", "rows").join(labels.hint("merge"), "node", "left")
    of = scratch.keep("named", named.filter("label is not null or rows > 1").withColumn("label", F.coalesce("label", "node")))
    least_of = of.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("rows").alias("component_rows"))
    final = scratch.keep("final", shared.join_unique(of, least_of, "label", "node", "inner", broadcast=False).select("node", "component_id", "component_rows"))
    scratch.only("ids", "final")
    grouped = shared.join_unique(ids.filter("n > 0"), final, "node", "id", broadcast=False)
    alone = F.col("component_rows").isNull()
    some = grouped.select("id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_rows", F.lit(1).cast("long")).alias("component_rows"))
    return some.unionByName(ids.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("component_rows")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents' columns, one document for each group: the one with the least id.

    Documents without shingles (null, empty or blank texts) or without id all stay. Where an id is on several
    rows, it goes if all of its rows belong to groups with a lesser id; of rows with equal id and text one
    stays. An empty table gives no rows; other columns may have any names."""
    found = near_groups(docs, id_col, text_col, k, percent).filter("id is not null")
    byid = shared.written(found.groupBy("id").agg(F.min(F.when(F.col("id") > F.col("component_id"), 1).otherwise(0)).alias("gone"), F.count(F.lit(1)).alias("n")))
    rows = shared.packed(docs, id=F.col(id_col).cast("long"), text=F.col(text_col))
    gone = byid.filter("gone = 1").select("id")
    again = byid.filter("gone = 0 AND n > 1").select("id")
    kept = rows.join(gone.hint("merge"), "id", "left_anti")
    if again.isEmpty():
        return shared.unpacked(kept, docs.columns)
    # any row of equal id and text; the others of its columns come with it
    tagged = kept.withColumn("tag", F.xxhash64("text"))
    once = tagged.join(again.hint("merge"), "id", "left_semi").groupBy("id", "tag").agg(F.first("row").alias("row"))
    return shared.unpacked(kept.join(again.hint("merge"), "id", "left_anti").select("row").union(once.select("row")), docs.columns)

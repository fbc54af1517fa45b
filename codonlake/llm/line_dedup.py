"""Line dedup by pairwise alignment.

Documents overlap where they share hashes of lines or of runs of lines; the first holder of either is the
document with the least id that has it. Each document is aligned with the first holders of its shared lines
and runs, by patience diff over line hashes: lines that are unique in both documents are matched in the
longest order-keeping way, and equal neighbours join them. Blocks of matched lines are deleted from the later
document. A line is evidence for a pair if it has at least `EVIDENCE_WORDS` words, and is deleted then wherever it is
matched; a block of shorter ones is deleted if it has at least `BLOCK_WORDS`, so that short lines that documents
share by chance lead to nothing and are not deleted alone.

Runs are the shortest ones of adjacent lines, blank ones left out, that reach `BLOCK_WORDS`: one from each
line on, and one up to each line. Every line of a block that is long enough to be deleted is in such a run
inside the block, so a partner holds it with that run, even where the block's lines each have another holder.
Text in scripts without spaces between words counts as a word for every two characters.

A document has at most three partners a line, since each line and run names one holder; groups of copies are
aligned with their first document only, so no pairs inside a group are made and no frequent line is left
out. What is shuffled for finding and aligning pairs is hashes of lines; the pair table is joined with
line hashes by id, and texts are read once more to be rebuilt. A line that a large part of all documents has is one
key of the join with holders, and its first holder one key of the next: such keys' rows are dealt to parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import shared
from codonlake.llm.textarrays import mix

EVIDENCE_WORDS, BLOCK_WORDS = 5, 10
#: A character of a script without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, the longest sequence that is in order in both."""
    na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {x: j for j, x in enumerate(b[blo:bhi], blo) if nb[x] == 1}
    pairs = [(i, at[a[i]]) for i in range(alo, ahi) if na[a[i]] == 1 and a[i] in at]
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = last[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo < ahi and blo < bhi and (found := _anchors(a, b, alo, ahi, blo, bhi)):
            out += found
            for (i, j), (k, m) in zip([(alo - 1, blo - 1), *found], [*found, (ahi, bhi)], strict=True):
                if k - i > 1 and m - j > 1:
                    todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common_lines(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS, line: int = EVIDENCE_WORDS) -> list[int]:
    """Positions in b of the lines in matched blocks of at least `least` words, and of other matched lines of at least `line` words."""
    out: list[int] = []
    block: list[int] = []
    for k, (i, j) in enumerate(m := patience(a, b)):
        block.append(j)
        if k + 1 == len(m) or m[k + 1] != (i + 1, j + 1):
            out += block if sum(words[x] for x in block) >= least else [x for x in block if words[x] >= line]
            block = []
    return out


def evidence_keys(hashes: list[np.ndarray], words: list[np.ndarray], least: int = BLOCK_WORDS, line: int = EVIDENCE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, key) of the lines and runs of lines that are evidence, each once a document."""
    doc = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    if not len(doc):
        return doc, doc
    h, w = np.concatenate(hashes).astype(np.uint64), np.concatenate(words).astype(np.int64)
    h, w, doc = h[w > 0], w[w > 0], doc[w > 0]
    at, total = np.arange(len(doc)), np.concatenate([[0], np.cumsum(w)])
    end = np.searchsorted(total, total[:-1] + least)  # the run from each line on
    on = end <= np.searchsorted(doc, doc, "right")
    start = np.searchsorted(total, total[1:] - least, "right") - 1  # the run up to each line
    upto = start >= np.searchsorted(doc, doc)
    alone = w >= line
    first, n = np.concatenate([at[on], start[upto], at[alone]]), np.concatenate([(end - at)[on], (at + 1 - start)[upto], np.ones(alone.sum(), np.int64)])
    code = np.unique(first * (least + 1) + n)
    first, n = code // (least + 1), code % (least + 1)
    key = h[first]
    with np.errstate(over="ignore"):
        for k in range(1, least):
            more = n > k
            key[more] = mix(key[more] + mix(h[first[more] + k]) + np.uint64(k))
    found = pd.DataFrame({"doc": doc[first], "key": key.view(np.int64)}).drop_duplicates()
    return found.doc.to_numpy(), found.key.to_numpy()


def _evidence(least: int, line: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, h = evidence_keys(list(batch.hashes), list(batch.words), least, line)
            yield pd.DataFrame({"key": batch.key.to_numpy()[doc], "h": h})

    return run


def _align(least: int, line: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "key": batch.key, "tag": batch.tag,
                "gone": [np.array(common_lines(a.tolist(), b.tolist(), w.tolist(), least, line), np.int32) for a, b, w in zip(batch.held, batch.hashes, batch.words, strict=True)],
            })

    return run


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, line_words: int = EVIDENCE_WORDS) -> DataFrame:
    """key (id), tag (hash of the text), gone (sorted array of line numbers from 0) for the documents that lose lines.

    block_words: words of the least block that is deleted; line_words: of the least line that is evidence, and deleted, alone."""
    text = F.col(text_col)
    some = docs.filter(F.col(id_col).isNotNull() & text.isNotNull())
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")))
    wide = lambda x: count(F.trim(F.regexp_replace(x, UNSPACED, " "))) + F.ceil(F.regexp_count(x, F.lit(UNSPACED)) / 2).cast("int")
    lined = some.select(
        F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("tag"), F.transform(trimmed, lambda x: F.xxhash64(x)).alias("hashes"), F.when(text.rlike(UNSPACED), F.transform(trimmed, wide)).otherwise(F.transform(trimmed, count)).alias("words")
    )
    lined = shared.cut(lined)
    evidence = shared.cut(lined.select("key", "hashes", "words").mapInPandas(_evidence(block_words, line_words), "key long, h long"))
    holders = evidence.groupBy("h").agg(F.min("key").alias("holder"), F.max("key").alias("last")).filter("holder < last").select("h", "holder")
    holders = shared.cut(holders)
    lines = shared.cut(shared.sieve(evidence, holders, "h"))
    pairs = shared.join_unique(lines, holders, "h", "key", "inner", broadcast=False).filter("key > holder").select("key", "holder").distinct()
    pairs = shared.cut(pairs)
    held = shared.sieve(lined, pairs.select(F.col("holder").alias("key")), "key").select(F.col("key").alias("holder"), F.col("hashes").alias("held"))
    own = shared.sieve(lined, pairs, "key")
    both = shared.join_unique(pairs, held, "holder", "key", "inner", broadcast=False).join(own, "key").select("key", "tag", "hashes", "words", "held")
    found = both.mapInPandas(_align(block_words, line_words), "key long, tag long, gone array<int>").filter(F.size("gone") > 0)
    # a document has one row for each of its partners, of which it has at most three a line
    return found.groupBy("key", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _rebuilt(docs: DataFrame, id_col: str, text_col: str, block_words: int, line_words: int) -> DataFrame:
    """row (all columns, packed), text (what is left of it), lines and lost (numbers of lines before, and deleted)."""
    gone = shared.cut(deletions(docs, id_col, text_col, block_words, line_words))
    ready = shared.packed(docs, text=F.col(f"`{text_col}`"), key=F.col(f"`{id_col}`").cast("long"), tag=F.xxhash64(F.col(f"`{text_col}`")))
    out = ready.join(gone, ["key", "tag"], "left")
    lines, lost = F.split("text", "\n"), F.coalesce(F.size("gone"), F.lit(0))
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return out.select("row", F.when(lost > 0, rest).otherwise(F.col("text")).alias("text"), count.alias("lines"), lost.alias("lost"))


def with_deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", gone_col: str = "n_deleted", block_words: int = BLOCK_WORDS, line_words: int = EVIDENCE_WORDS) -> DataFrame:
    """All columns of docs, with the text's common blocks deleted, and the numbers of its lines before, and deleted.

    Every row stays; a document whose every line is in an earlier one keeps an empty text. Null texts stay
    null, with no lines; empty texts have one empty line and lose nothing. Texts are worked on whole. Rows
    without id lose nothing and make others lose nothing. Rows with equal ids are no earlier or later than each
    other. Lines equal but for white space at their ends are equal. An empty table gives no rows. A result column
    whose name docs has gets an underscore more; other columns may have any names."""
    lines_col, gone_col = shared.free_names(docs, lines_col, gone_col)
    out = _rebuilt(docs, id_col, text_col, block_words, line_words)
    kept = [F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*kept, F.col("lines").alias(lines_col), F.col("lost").alias(gone_col))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, line_words: int = EVIDENCE_WORDS) -> DataFrame:
    """The documents' columns, whatever their names, with the text that is left. Nulls, repeats and empty tables as in `with_deletions`."""
    return shared.unpacked(_rebuilt(docs, id_col, text_col, block_words, line_words), docs.columns, **{text_col: F.col("text")})

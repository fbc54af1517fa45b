"""HTML extraction: gradient-boosted trees over the block elements of a page.

A page is parsed to a tree of block elements; inline markup belongs to the block around it. Trees score each
element from its tag and those above it, its attribute tokens, its depth, its place among its siblings, and
the density of text, links and elements below it. Decoding picks the likeliest set of kept elements in which
no kept element has a dropped ancestor, by dynamic programming over the page. Texts of kept elements, in page
order, are the main text. The trees are fitted here, on pages that are made by rule with their main text
known (`html_pages`), so fitting reads no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm.html_pages import Writer

INLINE = set("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: code, the head's title, what forms hold, what other pages or no browser shows.
RAW = frozenset("script style noscript template textarea title iframe".split())
#: A start tag closes open elements of these kinds, up to an element of the last list.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
KINDS = {
    t: k for k, tags in enumerate((
        "article main", "p", "h1", "h2 h3 h4 h5 h6", "div", "section", "nav menu", "header", "footer", "aside", "ul ol dl", "li dt dd", "table tbody thead tfoot tr td th caption",
        "form fieldset button select option legend", "blockquote pre address", "figure figcaption", "html body",
    )) for t in tags.split()
}
N_KINDS, BUCKETS = 18, 64
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of the markup in page order; comments and the like have no name.

    An element of `RAW` is one token with its content. A tag ends at the first > outside quotes. Where no such >
    follows, that tag and all after it end at the next >, and where none follows at all, the rest is text. So each
    character is looked at a bounded number of times."""
    at, quoted, lower = 0, True, None
    while (i := source.find("<", at)) >= 0:
        at = i + 1
        if source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = len(source) if j < 0 else j + 3
            yield i, at, "", False, ""
            continue
        closing = source.startswith("/", at)
        m = _NAME.match(source, at + closing)
        if not m and not source.startswith(("!", "?"), at):
            continue
        first = source.find(">", at)
        if first < 0:
            return
        end, k = first, m.end() if m else at
        while m and quoted:
            s = _STOP.search(source, k)
            if s is None:
                quoted = False
            elif s[0] == ">":
                end = s.start()
                break
            elif (k := source.find(s[0], s.end()) + 1) == 0:
                quoted = False
        at = end + 1
        name, attrs = (m[0].lower(), source[m.end() : end]) if m else ("", "")
        if name in RAW and not closing and not attrs.endswith("/"):
            lower = source.lower() if lower is None or len(lower) != len(source) else lower
            j = lower.find(f"</{name}", at) if len(lower) == len(source) else source.find(f"</{name}", at)
            k = source.find(">", j) if j >= 0 else -1
            at, name = len(source) if k < 0 else k + 1, ""
        elif name in RAW:
            name = ""
        yield i, at, name, closing, attrs


class Page:
    """Block elements in page order (parents first), and texts in page order with their element."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs, self.marked = ["html"], [-1], [()], [False]
        self.texts: list[tuple[int, str]] = []
        self.links: list[int] = [0]
        stack, at, buf, link, foreign, self.n_tags = [0], 0, [], 0, 0, [0]

        def flush() -> None:
            if buf:
                if text := " ".join(html.unescape("".join(x for x, _ in buf)).split()):
                    self.texts.append((stack[-1], text))
                    self.links[stack[-1]] += sum(len(x) for x, inside in buf if inside)
                buf.clear()

        for begin, end, tag, closing, raw in tokens(source):
            if begin > at:
                buf.append((source[at:begin], link > 0))
            at = end
            if not tag:
                continue
            if tag in ("math", "svg") and not raw.endswith("/"):
                foreign = max(0, foreign + (-1 if closing else 1))
            if tag in INLINE or tag in VOID or foreign:  # what a formula or drawing holds is part of the line
                if tag == "a":
                    link = 0 if closing else 1
                elif tag in ("br", "hr", "wbr", "img", "input"):
                    buf.append((" " if tag != "wbr" else "", False))
                self.n_tags[stack[-1]] += 1
                continue
            flush()
            link = 0
            if closing:
                if (k := next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag), 0)) and tag not in ("html", "body"):
                    del stack[k:]
                continue
            if tag in ("html", "head", "body"):
                continue
            if self.tag[stack[-1]] == "p":
                stack.pop()
            ends, stops = CLOSES.get(tag, ((), ()))
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in stops:
                        break
                    if self.tag[stack[i]] in ends:
                        del stack[i:]
                        break
            found = tuple(sorted({t for a in _ATTR.finditer(raw) for t in _PARTS.findall((a[2] or a[3] or a[4] or "").lower())}))
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attrs.append(found)
            self.marked.append("data-x" in raw)
            self.links.append(0)
            self.n_tags.append(0)
            stack.append(len(self.tag) - 1)
        if at < len(source):
            buf.append((source[at:], link > 0))
        flush()


def features(page: Page) -> np.ndarray:
    """elements x features."""
    n = len(page.tag)
    kind = np.array([KINDS.get(t, N_KINDS - 1) for t in page.tag])
    x = np.zeros((n, 2 * N_KINDS + 2 * BUCKETS + 14), np.float32)
    own, below, link, commas, tags = (np.zeros(n) for _ in range(5))
    first = np.full(n, -1.0)
    total = 0
    for k, text in page.texts:
        own[k] += len(text)
        commas[k] += text.count(",") + text.count(".")
        if first[k] < 0:
            first[k] = total
        total += len(text)
    link[:] = page.links
    chars, links, marks, blocks = own.copy(), link.copy(), commas.copy(), np.ones(n)
    tags[:] = page.n_tags
    depth, children, place, alike = (np.zeros(n) for _ in range(4))
    seen: dict[tuple[int, str], int] = {}
    x[np.arange(n), kind] = 1
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        key = (p, page.tag[i])
        seen[key] = seen.get(key, 0) + 1
        x[i, N_KINDS : 2 * N_KINDS] = np.maximum(x[p, N_KINDS : 2 * N_KINDS], x[p, :N_KINDS])
        a = 2 * N_KINDS
        x[i, a + BUCKETS : a + 2 * BUCKETS] = np.maximum(x[p, a : a + BUCKETS], x[p, a + BUCKETS : a + 2 * BUCKETS])
        for t in page.attrs[i]:
            x[i, a + zlib.crc32(t.encode()) % BUCKETS] = 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i]
        tags[p] += tags[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    for i in range(1, n):
        alike[i] = seen[(page.parent[i], page.tag[i])]
    around = np.array([children[p] if p >= 0 else 1 for p in page.parent])
    up = np.maximum(page.parent, 0)
    cols = (
        depth, np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / (blocks + tags), marks / np.maximum(chars, 1) * 100, place, place / np.maximum(around, 1), np.log1p(around),
        np.log1p(alike), chars / max(total, 1), np.maximum(first, 0) / max(total, 1), np.log1p(blocks), links[up] / np.maximum(chars[up], 1),
    )
    x[:, -14:] = np.stack(cols, 1)
    return x


class Trees:
    """Boosted trees of a fixed depth for a binary label, on binned features."""

    def __init__(self, depth: int = 5, rounds: int = 40, rate: float = 0.25, bins: int = 32) -> None:
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [np.array([0.5]) if set(np.unique(x[:, j])) <= {0, 1} else e for j, e in enumerate(self.edges)]
        b, (n, m) = self._binned(x), x.shape
        flat = (b + np.arange(m) * self.bins).ravel()
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at, split, cut = np.zeros(n, np.int64), np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 20:
                        continue
                    idx = flat.reshape(n, m)[rows].ravel()
                    gs = np.bincount(idx, np.repeat(g[rows], m), m * self.bins).reshape(m, self.bins).cumsum(1)
                    hs = np.bincount(idx, np.repeat(h[rows], m), m * self.bins).reshape(m, self.bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    k = int(gain.argmax())
                    if gain.ravel()[k] > 1e-6:
                        split[node], cut[node] = divmod(k, self.bins)
                at = 2 * at + 1 + (b[np.arange(n), split[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            values = self.rate * gs / (hs + ridge)
            self.trees.append((split, cut, values))
            score += values[leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for split, cut, values in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, split[at]] > cut[at])
            out += values[at - (2**self.depth - 1)]
        return out


def decode(parent: list[int], logits: np.ndarray) -> np.ndarray:
    """The likeliest kept elements such that what is kept has no dropped ancestor; the root is kept."""
    n = len(parent)
    keep, drop = -np.log1p(np.exp(-logits)), -np.log1p(np.exp(logits))
    best = keep.copy()
    for i in range(n - 1, 0, -1):
        best[parent[i]] += max(best[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and best[i] >= drop[i]
    return out


def labels(page: Page) -> np.ndarray:
    """Of a made page: elements outside marked parts that hold text, themselves or below."""
    n = len(page.tag)
    bad, has = np.array(page.marked), np.zeros(n, bool)
    for i in range(1, n):
        bad[i] |= bad[page.parent[i]]
    for k, _ in page.texts:
        has[k] |= not bad[k]
    for i in range(n - 1, 0, -1):
        has[page.parent[i]] |= has[i]
    return has


def fit(pages: int = 500, seed: int = 1) -> Trees:
    made = [Page(w) for w in map(lambda k: Writer(seed * 100_003 + k).page(), range(pages))]
    return Trees().fit(np.concatenate([features(p) for p in made]), np.concatenate([labels(p) for p in made]).astype(float))


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    out = []
    logits = trees.logits(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
    at = 0
    for p in pages:
        kept = decode(p.parent, logits[at : at + len(p.tag)])
        at += len(p.tag)
        out.append("\n".join(t for k, t in p.texts if kept[k]))
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = 500) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null, empty and unreadable html gives an empty text; text without markup is one block of the root and
    kept. Repeated rows stay repeated; an empty table gives no rows."""
    held = pages.sparkSession.sparkContext.broadcast(fit(fit_pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                texts = extract(["" if s is None else s for s in part.html], held.value)
                yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")

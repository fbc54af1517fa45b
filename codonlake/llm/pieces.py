"""SentencePiece encoding and decoding in batched numpy.

Texts are cut in words where no piece can cross: before white space, and around characters that stand in no
longer piece. The distinct words of a batch are encoded once, those of equal length together: substring
hashes from running sums probe the sorted hashes of all pieces, which gives the piece of every substring.
From this table a unigram model takes the best path by Viterbi, position by position for all words at once,
with vectorised maxima that store backpointers. A byte-pair model (piece_bpe_32k.model is one) isn't defined
by a best path but by its merges: the pair with the best-ranked piece first, the leftmost of equals. Viterbi
doesn't give that model's ids, so the merges are run on the same table, one for each word at a time, for all
words of a length together. Characters without a piece become byte pieces, or the unknown piece where the
model has none.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from codonlake.llm import shared
from codonlake.llm.textarrays import _powers, chunks, mix

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Words above this length are merged one by one with a heap; distinct words that a worker remembers.
LONG, REMEMBER = 200, 300_000


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<f", buf, at)[0], at + 4
        else:
            size = varint()
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The pieces of a model file, and what encoding needs of them."""

    def __init__(self, data: bytes, viterbi: bool = False) -> None:
        self.pieces: list[str] = []
        scores, kinds, self.type, self.dummy, squeeze = [], [], UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(f.get(2, 0.0))
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.dummy, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2):
                    raise ValueError("models that change characters before encoding are not supported")
        if viterbi:
            self.type = UNIGRAM
        if squeeze:
            raise ValueError("models that squeeze white space are not supported")
        self.score, self.kind = np.array(scores, np.float64), np.array(kinds)
        if self.type not in (UNIGRAM, BPE) or any(k in (USER, UNUSED) for k in kinds):
            raise ValueError("only unigram and byte-pair models without user-defined or unused pieces are supported")
        self.unk = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.id_of = {self.pieces[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal):
            raise ValueError("a piece crosses words")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.longest = max(len(self.pieces[i]) for i in normal)
        joined = "".join(self.pieces[i] for i in normal)
        sizes = np.array([len(self.pieces[i]) for i in normal])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums, q = self._sums(codes[None])
        with np.errstate(over="ignore"):
            keys = mix((sums[0, starts + sizes] - sums[0, starts]) * q[starts] + sizes.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        inner = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        alone = f"[^{re.escape(''.join(sorted(inner | {SPACE})))}]"
        self.words = re.compile(f"{SPACE}*(?:(?!{SPACE})(?!{alone}).)+|{SPACE}+|(?s:.)")
        # what each id stands for, as bytes
        self.out = [b"" if kinds[i] in (CONTROL,) else bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else " ⁇ ".encode() if kinds[i] == UNKNOWN else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.known: dict[str, bytes] = {}  # ids of words, 4 bytes each

    @staticmethod
    def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums along the rows, with a zero in front, and the inverse powers."""
        p, q = _powers(codes.shape[1] + 1)
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * p[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out, q

    def spans(self, codes: np.ndarray) -> np.ndarray:
        """words x starts x lengths: the id of the substring's piece, or -1."""
        n, size = codes.shape
        most = min(size, self.longest)
        sums, q = self._sums(codes)
        out = np.full((n, size, most), -1, np.int32)
        for m in range(1, most + 1):
            at = np.arange(size - m + 1)
            with np.errstate(over="ignore"):
                h = mix((sums[:, m:] - sums[:, : size - m + 1]) * q[at] + np.uint64(m))
            w, i = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            hit = h[w, i]
            k = np.minimum(np.searchsorted(self.keys, hit), len(self.keys) - 1)
            same = self.keys[k] == hit
            out[w[same], i[same], m - 1] = self.ids[k[same]]
        return out

    def viterbi(self, spans: np.ndarray) -> np.ndarray:
        """words x positions: the end of the piece that starts there on the best path, or 0."""
        n, size, most = spans.shape
        worst = self.score[self.kind == NORMAL].min() - 10.0
        best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for j in range(1, size + 1):
            m = np.arange(1, min(j, most) + 1)
            ids = spans[:, j - m, m - 1]
            s = np.where(ids >= 0, self.score[ids], np.where(m == 1, worst, -np.inf)) + best[:, j - m]
            k = s.argmax(1)
            best[:, j], back[:, j] = s[np.arange(n), k], j - m[k]
        ends, at = np.zeros((n, size), np.int64), np.full(n, size)
        while (go := np.flatnonzero(at > 0)).size:
            b = back[go, at[go]]
            ends[go, b] = at[go]
            at[go] = b
        return ends

    def merged(self, spans: np.ndarray) -> np.ndarray:
        """The same for the model's merges."""
        n, size, most = spans.shape
        ends = np.tile(np.arange(1, size + 1), (n, 1))
        live, start = np.arange(n), np.arange(size)
        scores = np.append(self.score, -np.inf)
        while len(live) and size > 1:
            e = ends[live]
            after = np.take_along_axis(np.concatenate([e, np.zeros((len(live), 1), np.int64)], 1), e, 1)
            m = after - start
            ok = (e > 0) & (after > 0) & (m <= most)
            ids = spans[live[:, None], start, np.where(ok, m - 1, 0)]
            s = scores[np.where(ok & (ids >= 0), ids, len(self.score))]
            k = s.argmax(1)
            rows = np.arange(len(live))
            can = s[rows, k] > -np.inf
            live, k, rows = live[can], k[can], rows[can]
            mid = e[rows, k]
            ends[live, k] = after[rows, k]
            ends[live, mid] = 0
        return ends

    def _one(self, word: str) -> np.ndarray:
        """A long word, with a heap of pairs."""
        parts, n = list(word), len(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and len(parts[i]) + len(parts[j]) <= self.longest and (p := self.id_of.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[p], i, len(parts[i]), len(parts[j])))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return np.array([x for p in parts if p for x in self._id(p)], np.int32)

    def _id(self, part: str) -> list[int]:
        if part in self.id_of:
            return [self.id_of[part]]
        return [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unk]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            if size > LONG and self.type == BPE:
                self.known.update((w, self._one(w).tobytes()) for w in group)
                continue
            room = max(1, 1_000_000 // (size * min(size, self.longest)))
            for at in range(0, len(group), room):
                some = group[at : at + room]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
                spans = self.spans(codes)
                ends = self.merged(spans) if self.type == BPE else self.viterbi(spans)
                w, i = np.nonzero(ends)
                ids = spans[w, i, ends[w, i] - i - 1]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(some)))])
                plain = np.ones(len(some), bool)
                plain[w[ids < 0]] = False
                raw, at4 = ids.tobytes(), (4 * cuts).tolist()
                self.known.update(zip(some, map(raw.__getitem__, map(slice, at4[:-1], at4[1:])), strict=True))
                for k in np.flatnonzero(~plain).tolist():
                    own = slice(cuts[k], cuts[k + 1])
                    mended = [y for x, p in zip(ids[own].tolist(), i[own].tolist(), strict=True) for y in ([x] if x >= 0 else self._id(some[k][p]))]
                    self.known[some[k]] = np.array(mended, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none for an empty one."""
        words = [self.words.findall((" " * self.dummy + t).replace(" ", SPACE)) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if len(self.known) > REMEMBER:
            self.known = {}
        codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
        self._learn([w for w in distinct if w not in self.known])
        found = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        store = np.frombuffer(b"".join(found), np.int32)
        begin = np.cumsum(sizes) - sizes
        n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = store[np.arange(upto[-1]) + np.repeat(begin[codes] - upto[:-1], n)] if len(codes) else store
        cuts = upto[np.concatenate([[0], np.cumsum([len(ws) for ws in words])])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _held(docs: DataFrame, model_path: str | None):
    """The model file, read on the driver and sent to the executors; it has a fixed size."""
    with open(model_path or default_model(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def tokenised(docs: DataFrame, text_col: str = "text", model_path: str | None = None, viterbi: bool = False, names: tuple[str, str, str] = ("token_ids", "n_tokens", "round_trip")) -> DataFrame:
    """All columns of docs with token_ids (array of int), n_tokens and round_trip (whether decoding gives the text back).

    viterbi: take the path of the best sum of scores, for byte-pair models too, whose own ids come from merges.
    Null and empty texts have no tokens; their round trip is the empty text. Texts are encoded whole, however
    long. The one character that decoding can't give back is U+2581, which stands for white space in pieces.
    Equal texts have equal ids; repeated rows stay repeated; an empty table gives no rows. A result column whose
    name docs has gets an underscore more."""
    names = shared.free_names(docs, *names)
    held = _held(docs, model_path)

    def function():
        model = Model(held.value, viterbi)

        def work(texts: list) -> Iterator[tuple[int, list[pa.Array]]]:
            for a, b in chunks(texts := ["" if t is None else t for t in texts], 1_000_000):
                ids = model.encode(texts[a:b])
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                same = [model.decode(x) == t for x, t in zip(ids, texts[a:b], strict=True)]
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield b - a, [pa.ListArray.from_arrays(pa.array(at), flat), pa.array(sizes), pa.array(same, pa.bool_())]

        return work

    return shared.with_texts(docs, text_col, dict(zip(names, (ArrayType(IntegerType()), IntegerType(), BooleanType()), strict=True)), function)


def detokenised(rows: DataFrame, ids_col: str = "token_ids", model_path: str | None = None, name: str = "decoded_text") -> DataFrame:
    """The rows with the decoded text; null ids and ids that are all null give the empty text. Repeats and empty tables as in `tokenised`."""
    name = shared.free_names(rows, name)[0]
    held = _held(rows, model_path)

    def function():
        model = Model(held.value)

        def work(lists: list) -> Iterator[tuple[int, list[pa.Array]]]:
            yield len(lists), [pa.array([model.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in lists], pa.string())]

        return work

    return shared.with_texts(rows, ids_col, {name: StringType()}, function)


def report(docs: DataFrame, id_col: str = "doc_id", viterbi: bool = False) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip for every row."""
    return tokenised(docs.select(F.col(id_col).alias("doc_id"), "text"), viterbi=viterbi).select("doc_id", "n_tokens", "token_ids", "round_trip")

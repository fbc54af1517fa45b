"""A linear-chain conditional random field over hashed word features.

Training maximises the likelihood of labelled sequences of equal length by AdaGrad over mini-batches, with
gradients from forward-backward. For inference any number of texts of any length are one stream of words:
the stream is cut in blocks, blocks advance together word by word to get their transfer matrices, the
matrices are chained over the blocks, and a second pass gives exact marginals. A text's first word forgets
the word before it, so blocks need not heed texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from codonlake.llm.textarrays import Features, Words


@dataclass
class Model:
    table: np.ndarray  # slots x states
    trans: np.ndarray  # states x states, by the earlier state
    start: np.ndarray
    bits: int
    prefixes: tuple[int, ...]
    suffixes: tuple[int, ...]
    trigrams: bool

    def features(self, words: Words) -> Features:
        return Features(words, self.bits, self.prefixes, self.suffixes, self.trigrams)

    def marginals(self, words: Words) -> np.ndarray:
        """Words x states."""
        first = np.concatenate([[True], words.doc[1:] != words.doc[:-1]]) if len(words) else np.zeros(0, bool)
        return marginals(self.features(words).emissions(self.table), first, self.trans, self.start)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, length: int = 128) -> np.ndarray:
    """Exact posterior of each state at each word of a stream; `first` marks words that begin a sequence."""
    n, s = emit.shape
    if n == 0:
        return np.zeros((0, s))
    blocks = -(-n // length)
    e = np.exp(np.clip(emit - emit.max(1, keepdims=True), -60, 0))
    e = np.concatenate([e, np.ones((blocks * length - n, s))]).reshape(blocks, length, s)
    f = np.concatenate([first, np.ones(blocks * length - n, bool)]).reshape(blocks, length)
    t, b = np.exp(trans - trans.max()), np.exp(start - start.max())
    fresh = np.broadcast_to(b, (s, s))
    # transfer matrices of the blocks, forward: row i is the state before the block
    move = np.broadcast_to(np.eye(s), (blocks, s, s))
    for i in range(length):
        stepped = move @ t
        reset = f[:, i]
        if reset.any():
            stepped[reset] = move[reset].sum(2, keepdims=True) * fresh
        stepped *= e[:, i, None, :]
        move = stepped / stepped.sum((1, 2), keepdims=True)
    before, after = np.ones((blocks, s)) / s, np.ones((blocks, s)) / s
    for k in range(1, blocks):
        before[k] = _normal(before[k - 1] @ move[k - 1])
    for k in range(blocks - 2, -1, -1):
        after[k] = _normal(move[k + 1] @ after[k + 1])
    ahead = np.empty((length, blocks, s))
    a = before
    for i in range(length):
        a = np.where(f[:, i, None], b, a @ t) * e[:, i]
        a = a / a.sum(1, keepdims=True)
        ahead[i] = a
    z = after
    for i in range(length - 1, -1, -1):
        ahead[i] *= z
        w = z * e[:, i]
        z = np.where(f[:, i, None], 1.0, w @ t.T)
        z = z / z.sum(1, keepdims=True)
    return _normal(ahead).transpose(1, 0, 2).reshape(-1, s)[:n]


def _gradient(emit: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gold less expected counts for sequences x words x states: of emissions, transitions and starts."""
    n, length, s = emit.shape
    e, t, b = np.exp(emit - emit.max(2, keepdims=True)), np.exp(trans), np.exp(start)
    a, z = np.empty_like(e), np.empty_like(e)
    a[:, 0] = _normal(b * e[:, 0])
    for i in range(1, length):
        a[:, i] = _normal((a[:, i - 1] @ t) * e[:, i])
    z[:, -1] = 1.0
    for i in range(length - 2, -1, -1):
        z[:, i] = _normal((z[:, i + 1] * e[:, i + 1]) @ t.T)
    g = np.eye(s)[gold]
    post = _normal(a * z)
    pair = a[:, :-1, :, None] * t * (e[:, 1:] * z[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    seen = np.einsum("nis,nit->st", g[:, :-1], g[:, 1:])
    return g - post, seen - pair.sum((0, 1)), (g[:, 0] - post[:, 0]).sum(0)


def train(words: Words, labels: np.ndarray, length: int, states: int, bits: int = 17, prefixes=(2, 3, 4, 5), suffixes=(2, 3, 4), trigrams: bool = True, epochs: int = 3, rate: float = 0.3, batch: int = 128, l2: float = 1e-6, seed: int = 7) -> Model:
    """words: sequences of `length` words each, one after another; labels: a state for each word."""
    model = Model(np.zeros((1 << bits, states)), np.zeros((states, states)), np.zeros(states), bits, tuple(prefixes), tuple(suffixes), trigrams)
    feats = model.features(words)
    n = len(words) // length
    rng, acc, acc_t = np.random.default_rng(seed), np.full((1 << bits, states), 1e-3), np.full((states + 1, states), 1e-3)
    ends = np.concatenate([feats.first, [len(feats.letter)]]) if trigrams else None
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            seqs = order[at : at + batch]
            rows = (seqs[:, None] * length + np.arange(length)).ravel()
            fixed = feats.fixed[rows]
            emit = model.table[fixed].sum(1)
            if trigrams:
                sizes = ends[rows + 1] - ends[rows]
                owner = np.repeat(np.arange(len(rows)), sizes)
                flat = feats.letter[np.arange(sizes.sum()) + np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
                scale = 2.0 / sizes
                emit += np.add.reduceat(model.table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) * scale[:, None]
            de, dt, ds = _gradient(emit.reshape(len(seqs), length, states), labels[rows].reshape(len(seqs), length), model.trans, model.start)
            de = de.reshape(-1, states)
            idx, grads = [fixed.ravel()], [np.repeat(de, fixed.shape[1], 0)]
            if trigrams:
                idx.append(flat)
                grads.append((de * scale[:, None])[owner])
            slots, inverse = np.unique(np.concatenate(idx), return_inverse=True)
            every = np.concatenate(grads)
            g = np.stack([np.bincount(inverse, every[:, k], len(slots)) for k in range(states)], 1) / len(seqs)
            g -= l2 * model.table[slots]
            g[slots == 0] = 0
            acc[slots] += g**2
            model.table[slots] += rate * g / np.sqrt(acc[slots])
            gt = np.concatenate([dt, ds[None]]) / len(seqs)
            acc_t += gt**2
            step = rate * gt / np.sqrt(acc_t)
            model.trans += step[:-1]
            model.start += step[-1]
    model.table = model.table.astype(np.float32)
    return model

"""Linear-chain conditional random fields in numpy: training, Viterbi and forward-backward over batches of chains.

A token has a fixed number of binary features, given as columns of ids into the weights; id 0 stands for none.
"""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    """Over a short axis: one pass for each of its places."""
    parts = [x.take(i, axis) for i in range(x.shape[axis])]
    top = parts[0]
    for p in parts[1:]:
        top = np.maximum(top, p)
    total = np.exp(parts[0] - top)
    for p in parts[1:]:
        total += np.exp(p - top)
    return np.log(total) + top


class Crf:
    """weights (features, tags), steps (tag, next tag), starts and ends (tag)."""

    def __init__(self, features: int, tags: int):
        self.weights = np.zeros((features, tags))
        self.steps, self.starts, self.ends = np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(axis=1)

    def _marginals(self, e: np.ndarray, live: np.ndarray):
        """Of padded chains (n, length, tags): marginals of tags and the sums of those of steps; log of the partition sums."""
        n, length, k = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = self.starts + e[:, 0]
        for t in range(1, length):
            step = logsumexp(alpha[:, t - 1, :, None] + self.steps, 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        total = logsumexp(alpha[:, -1] + self.ends, 1)
        beta[:, -1] = self.ends
        for t in range(length - 2, -1, -1):
            step = logsumexp(self.steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], step, beta[:, t + 1])
        tag = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        steps = np.zeros((k, k))
        for t in range(1, length):
            joint = np.exp(alpha[:, t - 1, :, None] + self.steps + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            steps += joint[live[:, t]].sum(axis=0)
        return tag, steps, total

    def train(self, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
        """Adam on the penalised log likelihood of chains of (ids, tags)."""
        chains = [c for c in chains if len(c[1])]
        if not chains:
            return self
        n, length, width = len(chains), max(len(t) for _, t in chains), chains[0][0].shape[1]
        ids, tags, live = np.zeros((n, length, width), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
        for i, (x, t) in enumerate(chains):
            ids[i, : len(t)], tags[i, : len(t)], live[i, : len(t)] = x, t, True
        k = len(self.starts)
        onehot = np.eye(k)[tags] * live[..., None]
        last = live.sum(axis=1) - 1
        pairs = live[:, 1:]
        gold_steps = np.zeros((k, k))
        np.add.at(gold_steps, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
        parts = [self.weights, self.steps, self.starts, self.ends]
        first, second = ([np.zeros_like(p) for p in parts] for _ in range(2))
        flat = ids[live]
        for r in range(1, rounds + 1):
            e = self.emissions(ids.reshape(-1, width)).reshape(n, length, k)
            tag, steps, _ = self._marginals(e, live)
            away = (onehot - tag)[live]
            grad = np.zeros_like(self.weights)
            for c in range(width):
                for j in range(k):
                    grad[:, j] += np.bincount(flat[:, c], away[:, j], len(grad))
            ends = (onehot - tag)[np.arange(n), last].sum(axis=0)
            for p, g, m, v in zip(parts, (grad, gold_steps - steps, (onehot - tag)[:, 0].sum(axis=0), ends), first, second, strict=True):
                g = g / n - ridge * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
            self.weights[0] = 0
        return self

    def viterbi(self, e: np.ndarray, lengths: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """The best tags of chains that lie one after another in e (tokens, tags); chains of like length are decoded together."""
        out, starts = np.zeros(len(e), np.int64), np.cumsum(lengths) - lengths
        by = np.argsort(lengths, kind="stable")
        by = by[lengths[by] > 0]
        i = 0
        while i < len(by):
            j = min(len(by), i + max(1, most // int(lengths[by[i]])))
            while j > i + 1 and (j - i) * int(lengths[by[j - 1]]) > 2 * most:
                j = i + (j - i) // 2
            own = by[i:j]
            size = lengths[own]
            length = int(size[-1])
            at = starts[own][:, None] + np.minimum(np.arange(length), size[:, None] - 1)
            score = self.starts + e[at[:, 0]]
            back = np.zeros((len(own), length, e.shape[1]), np.int8)
            for t in range(1, length):
                step = score[:, :, None] + self.steps
                back[:, t] = step.argmax(axis=1)
                score = np.where((t < size)[:, None], step.max(axis=1) + e[at[:, t]], score)
            tag = (score + self.ends).argmax(axis=1)
            for t in range(length - 1, -1, -1):
                live = t < size
                out[at[live, t]] = tag[live]
                tag = np.where(live & (t > 0), back[np.arange(len(own)), t, tag], tag)
            i = j
        return out

    def marginals(self, e: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Marginals of the tags of chains that lie one after another in e; heads: whether a token is the first of its chain.

        Each token is the matrix that carries forward weights over it; the first of a chain forgets what was before.  Products
        of all prefixes and suffixes come from a scan in blocks, so that one very long chain costs no more than many short ones.
        """
        n, k = e.shape
        if not n:
            return np.zeros((0, k))
        tails = np.r_[heads[1:], True]
        e = e + tails[:, None] * self.ends
        e = np.exp(e - e.max(axis=1, keepdims=True)).T
        steps, starts = np.exp(self.steps), np.exp(self.starts)
        carry = np.empty((k, k, n))
        for i in range(k):
            for j in range(k):
                carry[i, j] = np.where(heads, starts[j], steps[i, j]) * e[j]
        forward = scan(carry).sum(axis=0)
        # what follows a token: the product of the next tokens' matrices, none beyond the chain's tail
        follow = np.ones((k, k, n))
        follow[:, :, :-1] = carry[:, :, 1:]
        follow[:, :, tails] = 1.0
        backward = scan(np.ascontiguousarray(np.swapaxes(follow, 0, 1)[:, :, ::-1])).sum(axis=0)[:, ::-1]
        both = forward * backward
        return (both / both.sum(axis=0)).T


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products along the first two axes, scaled to a largest entry of 1."""
    k = a.shape[0]
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    top = None
    for i in range(k):
        for j in range(k):
            x = a[i, 0] * b[0, j]
            for m in range(1, k):
                x += a[i, m] * b[m, j]
            out[i, j] = x
            top = x.copy() if top is None else np.maximum(top, x)
    out /= top
    return out


def scan(m: np.ndarray, width: int = 64) -> np.ndarray:
    """Products m[..., 0] ... m[..., i] for each i, each scaled to a largest entry of 1: rows of `width` first, then over the rows."""
    k, _, n = m.shape
    rows = -(-n // width)
    width = width if rows > 1 else n
    padded = np.empty((k, k, rows * width))
    padded[:, :, :n] = m
    padded[:, :, n:] = np.eye(k)[:, :, None]
    by = np.ascontiguousarray(padded.reshape(k, k, rows, width).transpose(0, 1, 3, 2))  # steps of all rows lie together
    by[:, :, 0] /= by[:, :, 0].max(axis=(0, 1))
    for t in range(1, width):
        by[:, :, t] = _product(by[:, :, t - 1], by[:, :, t])
    if rows > 1:
        before = scan(np.ascontiguousarray(by[:, :, -1, :-1]))
        by[:, :, :, 1:] = _product(before[:, :, None, :], by[:, :, :, 1:])
    return by.transpose(0, 1, 3, 2).reshape(k, k, -1)[:, :, :n]

"""Bags of hashed subwords, averaged embeddings and a linear softmax, trained jointly in numpy.

A text's bag holds, for each of its words, the word, its character n-grams
(as bytes of UTF-8, lower case) and the grams that touch its ends. Each hashes
to one of `buckets` embeddings; their mean goes to a linear softmax. Once
trained, embeddings times softmax weights is one number per bucket and class, so
scoring a text of any length is a sum of table entries. The table holds
fixed-point integers, so the sum does not depend on how texts are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

_K = np.uint32(0x9E3779B1)
_SCALE = 1 << 16


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


@dataclass
class Bags:
    """How texts become buckets."""

    buckets: int = 1 << 18
    orders: tuple[int, ...] = (3, 4, 5)

    def grams(self, words: C.Words):
        """(bucket of each gram, first gram of each row and their number), once for every kind of gram."""
        shift = np.uint32(32 - self.buckets.bit_length() + 1)
        buf, n = words.buf, len(words.buf)
        row_at = np.append(words.starts, n)[words.first]  # where a row's bytes begin, but for leading space
        if not len(words):
            return
        h = words.hashes()
        yield ((h >> C.U(32)).astype(np.uint32) >> shift, words.first)
        size = words.ends - words.starts
        x = buf.astype(np.uint32) + np.uint32(1)
        # room[i]: bytes from i to the end of its word
        room = np.zeros(n, np.int32)
        at = C.slices(np.arange(n), words.starts, words.ends)
        room[at] = np.repeat(words.ends, size) - at
        g = np.zeros(n, np.uint32)
        for k in range(1, max(self.orders) + 1):
            # g[i]: hash of the k bytes from i
            m = n - k + 1
            if m <= 0:
                return
            g = g[:m] * _K + x[k - 1 :]
            if k + 1 in self.orders or k in self.orders:
                mixed = g ^ (g >> np.uint32(15))
                mixed *= np.uint32(0x85EBCA6B + 2 * k)
            if k in self.orders:
                pos = np.flatnonzero(room[:m] >= k)
                yield (mixed[pos] >> shift, np.searchsorted(pos, row_at))
            if k + 1 in self.orders:
                long = size >= k
                first = np.append(0, np.cumsum(long))[words.first]
                yield ((mixed[words.starts[long]] * np.uint32(0xC2B2AE35)) >> shift, first)
                yield ((mixed[words.ends[long] - k] * np.uint32(0x27D4EB2F)) >> shift, first)

    def sums(self, words: C.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of table rows (int64, rows by classes) and numbers of grams."""
        rows = len(words.first) - 1
        out, count = np.zeros((rows, table.shape[1]), np.int64), np.zeros(rows, np.int64)
        for bucket, first in self.grams(words):
            count += np.diff(first)
            for c in range(table.shape[1]):
                total = np.append(0, np.cumsum(table[:, c][bucket], dtype=np.int64))
                out[:, c] += total[first[1:]] - total[first[:-1]]
        return out, count

    def counted(self, texts: list[str], at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(distinct buckets, how often each, size of the bag) of each text, a few texts at a time."""
        for k in range(0, len(texts), at_once):
            for lo, hi, words in C.pieces(lowered(pa.array(texts[k : k + at_once], pa.large_string()))):
                here: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
                for bucket, first in self.grams(words):
                    for i in range(hi - lo):
                        here[i].append(bucket[first[i] : first[i + 1]])
                for parts in here:
                    b, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
                    yield b.astype(np.uint32), c.astype(np.uint32), int(c.sum())

    def bag(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct buckets, share of the bag) of each text."""
        return [(b, (c / max(1, n)).astype(np.float32)) for b, c, n in self.counted(texts)]


@dataclass
class _Held:
    """Bags of many texts in two flat arrays of bounded width; what `keep` denies is not held, but counts in the size."""

    first: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, bags: Bags, texts: list[str], keep: np.ndarray) -> _Held:
        held, sizes = [], []
        for b, c, n in bags.counted(texts):
            k = keep[b]
            held.append((b[k], np.minimum(c[k], 65535).astype(np.uint16)))
            sizes.append(max(1, n))
        first = np.append(0, np.cumsum([len(b) for b, _ in held]))
        join = lambda i, kind: np.concatenate([x[i] for x in held]) if held else np.empty(0, kind)
        return cls(first, join(0, np.uint32), join(1, np.uint16), np.array(sizes, np.float32))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[i], self.first[i + 1])
        return self.buckets[at], self.counts[at].astype(np.float32) / self.sizes[i]


@dataclass
class Model:
    bags: Bags
    classes: list
    table: np.ndarray  # int32, buckets by classes; one column for two classes
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, words: C.Words) -> np.ndarray:
        total, count = self.bags.sums(words, self.table)
        z = total / (np.maximum(count, 1)[:, None] * float(_SCALE)) + self.bias
        return np.hstack([np.zeros_like(z), z]) if len(self.classes) == 2 else z

    def probabilities(self, words: C.Words) -> np.ndarray:
        return softmax(self.logits(words) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list, bags: Bags, dim: int = 8, epochs: int = 6, rate: float = 0.5, scale: float = 30.0, least_df: int = 1, weights: dict | None = None, seed: int = 5) -> Model:
    """Adaptive stochastic gradient descent on embeddings and softmax together. No texts: a model of one class, None."""
    classes = sorted(set(labels)) or [None]
    y = np.searchsorted(np.array(classes), np.array(labels)) if labels else np.empty(0, int)
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((bags.buckets, dim)) * 0.01).astype(np.float32)
    w = (rng.standard_normal((dim, len(classes))) * 0.5).astype(np.float32)
    b = np.zeros(len(classes), np.float32)
    ge, gw, gb = np.full(bags.buckets, 1e-8, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(b.shape, 1e-6, np.float32)
    often = np.zeros(bags.buckets, np.int32)
    for idx, _, _ in bags.counted(texts):
        often[idx] += 1
    # what few texts have teaches noise only; it counts in a bag's size, with a vector of zero
    e[often < least_df] = 0
    bag = _Held.of(bags, texts, often >= least_df)
    cost = np.array([(weights or {}).get(c, 1.0) for c in classes], np.float32)
    for epoch in range(epochs if len(classes) > 1 else 0):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            idx, share = bag[i]
            mean = share @ e[idx] * scale
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= cost[y[i]]
            back = (w @ p) * scale
            gw += np.outer(mean, p) ** 2
            gb += p**2
            w -= step * np.outer(mean, p) / np.sqrt(gw)
            b -= step * 0.1 * p / np.sqrt(gb)
            ge[idx] += share**2 * (back @ back) / dim
            e[idx] -= step * (share / np.sqrt(ge[idx]))[:, None] * back[None, :]
    table = (e @ w) * (scale * _SCALE)
    bias = b.astype(np.float64)
    if len(classes) == 2:  # the difference of two logits does
        table, bias = table[:, 1:] - table[:, :1], bias[1:] - bias[:1]
    return Model(bags, classes, np.clip(np.rint(table), -(2**31), 2**31 - 1).astype(np.int32), bias)


def calibrate(model: Model, texts: list[str], labels: list, precision: float = 0.99) -> Model:
    """Sets the temperature by likelihood, and `accept`: the least score above which `precision` of the predictions hold."""
    if not texts or len(model.classes) < 2:
        return model
    z = np.concatenate([model.logits(words) for _, _, words in C.pieces(lowered(pa.array(texts, pa.large_string())))])
    known = np.array([t in model.classes for t in labels])
    z, y = z[known], np.searchsorted(np.array(model.classes), np.array([t for t, k in zip(labels, known, strict=True) if k]))
    if not len(y):
        return model
    grid = 2.0 ** np.arange(-4, 5, 0.25)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    model.accept = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(a, b, loss) of the logistic curve a * z + b through 0/1 labels: Newton's method, lightly damped."""
    scale = float(np.abs(z).mean()) or 1.0
    x = np.stack([z / scale, np.ones_like(z)], 1)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    v = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (p - t) + v * 1e-3)
        v = v - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ v, -30, 30))), 1e-7, 1 - 1e-7)
    return v[0] / scale, v[1], float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())


def prune(model: Model, texts: list[str], labels: list, shares: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)) -> Model:
    """Soft-thresholds the table of a two-class model: weights that are noise go, and the scores become probabilities.

    The threshold (as a share of the 99.9th percentile of weights) and the
    logistic curve on top are those of the least loss on the texts given.
    """
    y = np.array([t == model.classes[-1] for t in labels], float)
    if len(model.classes) != 2 or not 0 < y.sum() < len(y):
        return model
    table = model.table[:, 0].astype(np.float32)
    bag = _Held.of(model.bags, texts, table != 0)
    size = np.abs(table[table != 0])
    best = None
    for share in shares:
        cut = share * np.percentile(size, 99.9) if len(size) else 0.0
        less = np.sign(table) * np.maximum(np.abs(table) - cut, 0)
        a, b, loss = _platt(np.array([x @ less[b] for b, x in map(bag.__getitem__, range(len(texts)))]) / _SCALE, y)
        if a > 0 and (best is None or loss < best[0]):
            best = (loss, less * a, b)
    if best is None:
        return model
    _, less, b = best
    # a text without a gram that counts is no worse than the average
    return Model(model.bags, model.classes, np.clip(np.rint(less), -(2**31), 2**31 - 1).astype(np.int32)[:, None], np.array([b]))

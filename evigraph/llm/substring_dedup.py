"""Exact removal of repeated word windows by super-k-mer partitioning.

Consecutive windows of a document that share a minimiser (the least hash among
their `m`-word grams) form a super-k-mer: it travels once, as one packed string,
to the bucket of its minimiser. Equal windows have equal minimisers, so each
bucket alone can sort its windows and tell, exactly, which are in a smaller
document too. Packed strings of one bucket and one task share a compressed row.

Grams that make up more than `hot_share` of all grams come last in the order of
minimisers, so that no bucket grows with one phrase. The share shrinks with the
corpus, as that of a bucket does, down to HOT_LEAST: at most 1 / HOT_LEAST grams
(8 MB) are broadcast. A window of nothing but such
grams takes a second path: equal packed strings are combined in each task and
again by an aggregation, their distinct windows are counted, and the outcome is
joined back to the tasks' combined rows. No group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_HOT = C.U(1 << 63)
_FLUSH = 24 << 20  # packed bytes that a task gathers before it writes rows
_BUCKET = 6 << 20  # packed bytes that a bucket should hold
HOT_LEAST = 2.0**-20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class _Cut:
    """The super-k-mers of a piece of text: word index, number of windows, minimiser and whether all its grams are hot."""

    def __init__(self, words: C.Words, k: int, m: int, hot: np.ndarray):
        h = words.hashes()
        self.begin = self.count = self.row = np.empty(0, np.int64)
        self.least, self.hot = np.empty(0, C.U), np.empty(0, bool)
        last = np.repeat(words.first[1:], words.counts)
        n = len(h) - k + 1
        if n <= 0:
            return
        at = np.flatnonzero(np.arange(n) + k <= last[:n])
        if not len(at):
            return
        # grams across rows are harmless: no window of `at` holds one
        gram = _chained(h, m)
        key = gram >> C.U(1)
        if len(hot):
            i = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
            key[hot[i] == gram] |= _HOT
        low = _least(key, k - m + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])
        i = np.flatnonzero(new)
        self.begin, self.least = at[i], low[i]
        self.count = np.diff(np.append(i, len(at)))
        self.hot = self.least >= _HOT
        self.row = np.searchsorted(words.first, self.begin, "right") - 1


def _chained(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all m consecutive words, rows disregarded."""
    n = len(h) - m + 1
    g = h[:n].copy()
    for i in range(1, m):
        g = (g * C.U(0x9E3779B97F4A7C15)) ^ h[i : n + i]
    return C.mix(g)


def _count_grams(k: int, m: int, share: float) -> Callable:
    """Of every 4 million grams or so, those with half the share or more (and one row with the number of grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(4, size * share / 2)
            return pa.RecordBatch.from_arrays([pa.array([None, *g[often].view(np.int64).tolist()], pa.int64()), pa.array([size, *c[often].tolist()], pa.int64())], ["g", "c"])

        for batch in batches:
            for _, _, words in C.pieces(batch.column(0)):
                h = words.hashes()
                if len(h) >= m:
                    held.append(_chained(h, m))
                    size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def hot_grams(docs: DataFrame, k: int, m: int, share: float, least: int) -> list[int]:
    """Grams with `share` of all, or a little less, and at least `least` times; at most 1 / share of them."""
    counts = docs.select("text").mapInArrow(_count_grams(k, m, share), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.col("g").isNotNull(), F.desc("c")).limit(1 + int(1 / share)).collect()
    total = sum(r.c for r in top if r.g is None)
    return sorted((r.g for r in top if r.g is not None and r.c >= max(least, total * share)), key=lambda g: g % (1 << 64))


_PACKED = "bucket long, n long, size long, blob binary"


def _pack_light(k: int, m: int, hot: list[int], buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(hot, np.int64).view(C.U)
        held, size = defaultdict(list), 0

        def out() -> pa.RecordBatch:
            rows = []
            for b, parts in held.items():
                doc, begin, length, text = (np.concatenate(x) for x in zip(*parts, strict=True))
                raw = b"".join((doc.tobytes(), begin.tobytes(), length.tobytes(), text.tobytes()))
                rows.append((b, len(doc), len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int64()) for i in range(3)] + [pa.array(cols[3], pa.binary())], ["bucket", "n", "size", "blob"])

        for batch in batches:
            ids = C.ids_of(batch.column(0))
            for lo, _, words in C.pieces(batch.column(1)):
                cut = _Cut(words.squeeze(), k, m, frequent)
                pick = np.flatnonzero(~cut.hot)
                if not len(pick):
                    continue
                to = (C.mix(cut.least[pick]) % C.U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                pick, to = pick[order], to[order]
                begin = cut.begin[pick]
                s, e = words.starts[begin], words.ends[begin + cut.count[pick] + k - 2]
                text, length = C.slices(words.buf, s, e), (e - s).astype(np.int32)
                at = np.append(0, np.cumsum(length, dtype=np.int64))
                row = cut.row[pick]
                doc, first = ids[lo + row], (begin - words.first[row]).astype(np.int32)
                edge = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    held[int(to[x])].append((doc[x:y], first[x:y], length[x:y], text[at[x] : at[y]]))
                size += len(text)
                if size > _FLUSH:
                    yield out()
                    held, size = defaultdict(list), 0
        if held:
            yield out()

    return run


def _first_docs(words: C.Words, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the rows: its word index, and the smallest doc of a row that holds the same words. Exact."""
    h, at = words.grams(words.hashes(), k)
    own = doc[np.searchsorted(words.first, at, "right") - 1]
    if not len(at):
        return at, own
    order = np.argsort(h, kind="stable")
    g = h[order]
    edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    low = np.minimum.reduceat(own[order], edge)
    size = np.diff(np.append(edge, len(g)))
    first = np.empty_like(own)
    first[order] = np.repeat(low, size)
    # the windows of a hash must have the bytes of its first window
    many = np.repeat(size > 1, size)
    that, lead = order[many], np.repeat(order[edge], size)[many]
    s, e = words.starts[at], words.ends[at + k - 1]
    for i in range(0, len(that), 1 << 14):
        x, y = that[i : i + (1 << 14)], lead[i : i + (1 << 14)]
        if not (np.array_equal(e[x] - s[x], e[y] - s[y]) and np.array_equal(C.slices(words.buf, s[x], e[x]), C.slices(words.buf, s[y], e[y]))):
            exact: dict[bytes, int] = {}
            text = [words.buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            for w, d in zip(text, own.tolist(), strict=True):
                exact[w] = min(d, exact.get(w, d))
            return at, np.array([exact[w] for w in text], np.int64)
    return at, first


def _runs(words: C.Words, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, k: int) -> list[pa.Array]:
    """Marked windows as runs: document, its word, number of windows, checksum of the words."""
    row = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(at)))
    a, r = at[i], row[i]
    buf = memoryview(np.ascontiguousarray(words.buf))
    crc = [zlib.crc32(buf[s:e]) for s, e in zip(words.starts[a].tolist(), words.ends[a + n + k - 2].tolist(), strict=True)]
    return [pa.array(doc[r]), pa.array((begin[r] + a - words.first[r]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())]


_RUNS = "doc long, begin long, n long, crc long"
_NAMES = ["doc", "begin", "n", "crc"]


def _count_light(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        parts = []
        for n, size, blob in zip(*(group.column(c).to_pylist() for c in ("n", "size", "blob")), strict=True):
            raw = pa.decompress(blob, size, codec="zstd", asbytes=True)
            doc, begin, length = (np.frombuffer(raw, t, n, o) for t, o in ((np.int64, 0), (np.int32, 8 * n), (np.int32, 12 * n)))
            parts.append((doc, begin, length, np.frombuffer(raw, np.uint8, -1, 16 * n)))
        doc, begin, length, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        words = C.Words(text, np.append(0, np.cumsum(length, dtype=np.int64)))
        at, first = _first_docs(words, doc, k)
        again = first < doc[np.searchsorted(words.first, at, "right") - 1]
        return pa.Table.from_arrays(_runs(words, at[again], doc, begin, k), _NAMES)

    return run


_HEAVY = "packed binary, least long, low long, docs array<long>, begins array<long>"


def _pack_heavy(k: int, m: int, hot: list[int]) -> Callable:
    """Packed strings of hot grams alone; equal ones of a task share a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(hot, np.int64).view(C.U)
        held: dict[bytes, tuple[int, list[int], list[int]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            v = list(held.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([x[0] for x in v], pa.int64()), pa.array([min(x[1]) for x in v], pa.int64()), pa.array([x[1] for x in v], pa.list_(pa.int64())), pa.array([x[2] for x in v], pa.list_(pa.int64()))],
                ["packed", "least", "low", "docs", "begins"],
            )

        for batch in batches:
            ids = C.ids_of(batch.column(0))
            for lo, _, words in C.pieces(batch.column(1)):
                cut = _Cut(words.squeeze(), k, m, frequent)
                pick = np.flatnonzero(cut.hot)
                begin, row = cut.begin[pick], cut.row[pick]
                s, e = words.starts[begin], words.ends[begin + cut.count[pick] + k - 2]
                buf = words.buf.tobytes()
                least = (cut.least[pick] & ~_HOT).astype(np.int64)
                for x, y, d, b, g in zip(s.tolist(), e.tolist(), ids[lo + row].tolist(), (begin - words.first[row]).tolist(), least.tolist(), strict=True):
                    got = held.get(buf[x:y])
                    if got is None:
                        got = held[buf[x:y]] = (g, [], [])
                        size += y - x + 200
                    got[1].append(d)
                    got[2].append(b)
                    size += 80
                if size > _FLUSH:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return run


def _count_heavy(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        packed, low = group.column("packed").combine_chunks(), group.column("low").to_numpy()
        data = packed.to_pylist()
        words = C.Words(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
        at, first = _first_docs(words, low, k)
        return pa.Table.from_arrays([packed, pa.array(np.split(first, np.searchsorted(at, words.first[1:-1])), pa.list_(pa.int64()))], ["packed", "firsts"])

    return run


def _mark_heavy(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, docs, begins, firsts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = C.Words(np.frombuffer(packed, np.uint8), np.array([0, len(packed)]))
                doc, begin, first = np.array(docs), np.array(begins), np.array(firsts)
                low = first.min()
                again = doc > low
                doc, begin = doc[again], begin[again]
                for d, b in zip(doc, begin, strict=True):
                    yield pa.RecordBatch.from_arrays(_runs(words, np.flatnonzero(first < d), np.array([d]), np.array([b]), k), _NAMES)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in run(batches):
            held.append(x)
            if len(held) >= 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def repeated_runs(docs: DataFrame, k: int = 13, m: int = 3, hot_share: float = 2**-15, hot_least: int = 512) -> DataFrame:
    """(doc, begin, n, crc): n windows from word `begin` of document `doc` are in a smaller document too."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = 5 * C.input_bytes(docs)
    hot = hot_grams(docs, k, m, max(HOT_LEAST, min(hot_share, _BUCKET / max(1, size))), hot_least)
    buckets = max(2 * C.shuffle_partitions(docs.sparkSession), size // _BUCKET)
    light = docs.mapInArrow(_pack_light(k, m, hot, buckets), _PACKED).groupBy("bucket").applyInArrow(_count_light(k), _RUNS)
    if not hot:
        return light
    heavy = docs.mapInArrow(_pack_heavy(k, m, hot), _HEAVY)
    distinct = heavy.groupBy("packed", "least").agg(F.min("low").alias("low"))
    firsts = distinct.withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(buckets))).groupBy("bucket").applyInArrow(_count_heavy(k), "packed binary, firsts array<long>")
    marked = heavy.select("packed", "docs", "begins").join(firsts, "packed").select("packed", "docs", "begins", "firsts")
    return light.unionAll(marked.mapInArrow(_mark_heavy(k), _RUNS))


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _keep(k: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().split()
                n, gone = len(words), 0
                if runs and n >= k:
                    cover = np.zeros(n + 1, np.int64)
                    for r in runs:
                        b, e = r["begin"], r["begin"] + r["n"] + k - 1
                        # rows that share a doc_id share runs: a run counts where its words are
                        if e <= n and zlib.crc32(b" ".join(words[b:e])) == r["crc"]:
                            cover[b] += 1
                            cover[e] -= 1
                    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    gone = n - len(kept)
                    words = [words[i] for i in kept.tolist()] if gone else words
                kept = b" ".join(words)
                out.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, k: int = 13, with_text: bool = True, **how) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_removed, kept_sha256 and, if with_text, the kept words.

    Removes every word covered by a window of `k` consecutive words that also
    starts in a row with a smaller doc_id. A null or empty text has no words; a
    null doc_id counts as the largest; rows that share a doc_id are never
    "smaller" than each other and give one result row each. Other columns are
    ignored. No rows, no result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeated_runs(docs, k, **how).groupBy("doc").agg(F.collect_list(F.struct("begin", "n", "crc")).alias("runs"))
    joined = docs.join(runs, F.coalesce("doc_id", F.lit(2**63 - 1)) == runs.doc, "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(_keep(k, with_text), _KEPT)
    return out if with_text else out.drop("kept")

"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of two lengths, in words without case
and punctuation. A first pass over all passages counts, for every term of the
benchmark, the documents that hold it, and sums the range finder of a randomised
SVD, A'(A O) for a random O: each task adds up its own passages and the sums meet
by term. From that the right singular vectors of the TF-IDF matrix follow. In a
second pass every passage is projected on them; items of the benchmark (the
query set) whose cosine with the passage reaches `cosine` are candidates. A
candidate whose terms around the passage are too few for the shortest
subsequence that counts is dropped, which loses nothing. For each that is left,
the longest common subsequence of the item and the words around the passage is
found; a long one is a copy, a middling one counts if the item's answer is there
too. An item longer than the longest passage is cut into pieces
of that length, each looked for by itself; the item is judged as a whole.

Words that more than `common` of the items have are no terms: they tell nothing.
Items with the same words count once there, and an item left with fewer than FEW
terms gets its rarest words as terms all the same, so that none goes unsought.
What is broadcast is made from the benchmark alone, AT_ONCE items at a time; a
larger benchmark is looked for in as many rounds as it takes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STEP = 12  # words between passages; a passage is 2 or 4 steps long
SCALES = (2, 4)
_SIGNS = 8  # 64-bit words of a signature
FEW = 4  # terms that an item has at least, if it has so many words
AT_ONCE = 50_000  # items of a round: what is broadcast stays below 100 MB for items of up to 100 words

# letters, digits and all bytes beyond ASCII are words' bytes; the rest is space
_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def folded(column: pa.Array) -> Iterator[tuple[int, int, C.Words, np.ndarray]]:
    """Pieces of a column as words without case and ASCII punctuation, and the words' hashes."""
    for lo, hi, words in C.pieces(column, fold=_FOLD):
        yield lo, hi, words, words.hashes()


@dataclass
class Index:
    """What the passes need to know of the benchmark."""

    ids: list
    tokens: list[np.ndarray]  # hashes of each item's words
    answers: list[np.ndarray]
    terms: np.ndarray  # sorted hashes
    some: np.ndarray  # by the low bits of a hash: whether a term has them
    pieces: list[tuple[int, int, int]]  # what is looked for: item, its first word, the word after
    scale: np.ndarray  # by piece: index into SCALES

    def find(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.some[(h & C.U(len(self.some) - 1)).astype(np.int64)])
        if len(maybe):
            x = h[maybe]
            t = np.minimum(np.searchsorted(self.terms, x), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[t] == x, t, -1)
        return out


def index(items: list[tuple[object, str | None, str | None]], common: float = 0.1) -> Index:
    """From (item_id, text, answer); no answer: the item's last sentence if it has several, else its last quarter."""
    items = [(i, t or "", a) for i, t, a in items]
    hashes: list[np.ndarray] = []
    for part in (1, 2):
        texts = [t if part == 1 else (a if a is not None else _tail(t)) for _, t, a in items]
        for lo, hi, words, h in folded(pa.array(texts, pa.string())):
            hashes += [h[words.first[i] : words.first[i + 1]] for i in range(hi - lo)]
    n = len(items)
    tokens, answers = hashes[:n], hashes[n:]
    distinct = {t.tobytes(): np.unique(t) for t in tokens}
    term, df = np.unique(np.concatenate(list(distinct.values())) if n else np.empty(0, C.U), return_counts=True)
    kept = df <= max(2, common * len(distinct))
    rare = kept.copy()
    for t in distinct.values():
        at = np.searchsorted(term, t)
        if len(t) and kept[at].sum() < min(FEW, len(t)):
            rare[at[df[at] <= np.sort(df[at])[min(FEW, len(t)) - 1]]] = True
    terms = term[rare]
    some = np.zeros(1 << max(16, int(len(terms) * 16).bit_length()), bool)
    some[(terms & C.U(len(some) - 1)).astype(np.int64)] = True
    pieces = [(i, a, b) for i, t in enumerate(tokens) for a, b in _cut(len(t))]
    scale = np.array([int(b - a > 1.3 * SCALES[0] * STEP) for _, a, b in pieces], np.int64)
    return Index([i for i, _, _ in items], tokens, answers, terms, some, pieces, scale)


def _cut(n: int) -> list[tuple[int, int]]:
    """The whole of n words, or evenly spaced pieces as long as the longest passage, which cover all of them."""
    width = SCALES[-1] * STEP
    if n <= 1.3 * width:
        return [(0, n)]
    return [(a, a + width) for a in np.linspace(0, n - width, -(-n // width)).astype(int).tolist()]


def _tail(text: str) -> str:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 4) :])


def _blocks(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of STEP words, and the row of each; a row's last block may be short."""
    counts = words.counts
    per = -(-counts // STEP)
    row = np.repeat(np.arange(len(counts)), per)
    within = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return words.first[row] + within * STEP, row


def _windows(block_row: np.ndarray, width: int) -> np.ndarray:
    """Blocks at which a passage of `width` blocks begins; a row with fewer is one passage."""
    n = len(block_row)
    ends = np.minimum(np.arange(n) + width - 1, n - 1)
    first = np.append(True, block_row[1:] != block_row[:-1])[:n]
    whole = (block_row[ends] == block_row) & (np.arange(n) + width <= n)
    return np.flatnonzero(whole | first)


def _summed(x: np.ndarray, block_row: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Sums of `width` blocks from each of `at`, within the row."""
    out = x[at].copy()
    for i in range(1, width):
        j = np.minimum(at + i, len(x) - 1)
        same = (at + i < len(x)) & (block_row[j] == block_row[at])
        out[same] += x[j[same]]
    return out


def _survey(model, rank: int, seed: int) -> Callable:
    """Per task: for each term, the documents that hold it and its row of A'(A O), by counts of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = model.value
        v = len(ix.terms)
        omega = np.ascontiguousarray(np.random.default_rng(seed).standard_normal((v + 1, rank)).astype(np.float32).T)
        df, z, texts = np.zeros(v + 1, np.int64), np.zeros((v + 1, rank)), 0
        width = SCALES[0]
        for batch in batches:
            for _, _, words, h in folded(batch.column(0)):
                if not len(h):
                    continue
                block, row = _blocks(words)
                term = ix.find(h)
                hit = np.flatnonzero(term >= 0)
                own = np.searchsorted(block, hit, "right") - 1
                t = term[hit]
                at = _windows(row, width)
                texts += int((words.counts > 0).sum())
                x = np.zeros((len(block), rank), np.float32)
                for c in range(rank):
                    x[:, c] = np.bincount(own, omega[c][t], len(block))
                y = np.zeros_like(x)
                y[at] = _summed(x, row, at, width)
                # a word is in the passages from its block and from the block before
                back = y.copy()
                back[1:][row[1:] == row[:-1]] += y[:-1][row[1:] == row[:-1]]
                for c in range(rank):
                    z[:, c] += np.bincount(t, back[own, c], v + 1)
                pair = np.unique(row[own].astype(np.int64) * (v + 1) + t)
                df += np.bincount(pair % (v + 1), minlength=v + 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], texts)), pa.array([*(r.tobytes() for r in z[some]), b""], pa.binary())], ["term", "df", "z"])

    return run


def _add(group: pa.Table) -> pa.Table:
    term = group.column("term").to_numpy()
    out = []
    for t in np.unique(term):
        part = group.filter(pa.array(term == t))
        rows = [np.frombuffer(x) for x in part.column("z").to_pylist()]
        out.append((int(t), int(part.column("df").to_numpy().sum()), np.sum(rows, 0).tobytes()))
    a, b, c = zip(*out, strict=True)
    return pa.table({"term": pa.array(a, pa.int64()), "df": pa.array(b, pa.int64()), "z": pa.array(c, pa.binary())})


@dataclass
class Space:
    """The latent space: idf of each term, right singular vectors (terms by rank), singular values."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def place(self) -> np.ndarray:
        """What a word adds to its passage's latent vector, by term; the last row is for other words."""
        return np.vstack([self.vectors * self.idf[:, None], np.zeros((1, self.vectors.shape[1]))]).astype(np.float32)


def fit_space(docs: DataFrame, ix: Index, rank: int = 48, seed: int = 23) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages of docs (text): one pass, sums by term, the rest in numpy."""
    spark = docs.sparkSession
    v = len(ix.terms)
    model = spark.sparkContext.broadcast(ix)
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_survey(model, rank, seed), "term long, df long, z binary")
    sums = sums.withColumn("part", F.pmod("term", F.lit(4 * C.shuffle_partitions(spark)))).groupBy("part").applyInArrow(_add, "term long, df long, z binary")
    df, z, n = np.zeros(v), np.zeros((v, rank)), 0
    for r in sums.collect():  # one row for each term of the benchmark
        if r.term < 0:
            n = r.df
        elif r.term < v:
            df[r.term], z[r.term] = r.df, np.frombuffer(r.z)
    idf = np.log((1 + n) / (1 + df)) + 1
    omega = np.random.default_rng(seed).standard_normal((v + 1, rank)).astype(np.float32)[:v].astype(np.float64)
    # with A = T D (counts T, idf D) and O = omega / idf: A'(A O) = D z
    z *= idf[:, None]
    core = (omega / idf[:, None]).T @ z
    w, u = np.linalg.eigh((core + core.T) / 2)
    good = w > max(1e-9, 1e-9 * (w.max() if len(w) else 0))
    half = z @ (u[:, good] / np.sqrt(w[good]))  # Nystrom: A'A ~ half half'
    vectors, s, _ = np.linalg.svd(half, full_matrices=False)
    return Space(idf, vectors, s)


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, bit by bit, and how many words of b it takes at least to get there from the left."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, reach, best = full, 0, 0
    for j, x in enumerate(b.tolist()):
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            n = len(a) - v.bit_count()
            if n > best:
                best, reach = n, j + 1
    return best, reach


class _Bound:
    """What tells, of many candidates at once, those whose subsequence can't be long enough.

    A subsequence has no more words than the item's own that stand around the
    passage, and one of the few passages that cover it has its share of these.
    Terms are counted as bits of signatures: terms that share a bit within an
    item, and words that are no terms, are taken to be there, so nothing is lost.
    """

    def __init__(self, ix: Index, wanted: list[np.ndarray], close: float):
        bit = np.random.default_rng(13).integers(0, 64 * _SIGNS, len(ix.terms) + 1)
        self.term = np.zeros((len(ix.terms) + 1, _SIGNS), C.U)
        self.term[np.arange(len(bit)), bit // 64] = C.U(1) << (bit % 64).astype(C.U)
        self.term[-1] = 0
        self.size = np.array([len(ix.tokens[i]) for i, _, _ in ix.pieces], np.int64)
        self.sign = np.zeros((len(wanted), _SIGNS), C.U)
        self.share, self.all, self.words = np.ones((3, len(wanted)), np.int64)
        key, weight = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p, (i, a, b) in enumerate(ix.pieces):
            t, c = np.unique(ix.find(wanted[p]), return_counts=True)
            own = t >= 0
            self.sign[p] = np.bitwise_or.reduce(self.term[t[own]], axis=0) if own.any() else 0
            key.append(p * (len(ix.terms) + 1) + t[own])
            weight.append(c[own])
            if b - a < len(ix.tokens[i]):
                continue  # an item in pieces is judged as a whole, so a piece need but be touched
            self.words[p] = words = max(1, math.ceil(close * (b - a) - 1e-9) - int(c[~own].sum()))
            parts = 2 + -(-3 * (b - a) // (2 * SCALES[ix.scale[p]] * STEP))
            most = np.cumsum(np.sort(c[own])[::-1])
            lost = int(own.sum()) - int(np.bitwise_count(self.sign[p]).sum())
            # the fewest distinct terms that make up so many words, less those that may share a bit
            self.all[p] = max(1, 1 + np.searchsorted(most, words) - lost)
            self.share[p] = max(1, 1 + np.searchsorted(most, -(-words // parts)) - lost)

        self.key, self.weight = np.concatenate(key), np.concatenate(weight)

    def exact(self, piece: np.ndarray, left: np.ndarray, right: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Indices of the candidates whose hits from left to right hold as many of the item's words as it takes."""
        out = [np.empty(0, np.int64)]
        for lo in range(0, len(piece) if len(self.key) else 0, 1 << 13):
            p, a, n = piece[lo : lo + (1 << 13)], left[lo : lo + (1 << 13)], (right - left)[lo : lo + (1 << 13)]
            want = np.repeat(p * len(self.term), n) + C.slices(found, a, a + n)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            own = np.flatnonzero(self.key[at] == want)
            pair = np.unique(np.searchsorted(np.cumsum(n), own, "right") * len(self.key) + at[own])
            got = np.bincount(pair // len(self.key), self.weight[pair % len(self.key)], len(p))
            out.append(lo + np.flatnonzero(got >= self.words[p]))
        return np.concatenate(out)

    def blocks(self, found: np.ndarray, own: np.ndarray, n: int) -> list[np.ndarray]:
        """Signatures of runs of 1, 2, 4, ... blocks from each block."""
        level = np.zeros((n, _SIGNS), C.U)
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        if len(edge):
            level[own[edge]] = np.bitwise_or.reduceat(self.term[found], edge, axis=0)
        out = [level]
        while 2 ** len(out) <= n:
            half = 2 ** (len(out) - 1)
            up = out[-1].copy()
            up[:-half] |= out[-1][half:]
            out.append(up)
        return out

    def enough(self, piece: np.ndarray, least: np.ndarray, runs: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indices of the candidates whose blocks from begin to end hold `least` of their item's terms."""
        k = np.log2(np.maximum(end - begin, 1)).astype(np.int64)
        sign = np.empty((len(piece), _SIGNS), C.U)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            sign[at] = runs[level][begin[at]] | runs[level][end[at] - 2**level]
        return np.flatnonzero(np.bitwise_count(sign & self.sign[piece]).sum(1, dtype=np.int64) >= least[piece])


_HITS = "doc long, body long, item long, lcs double, cosine double, answer double, begin long"


def _search(model, cosine: float, copy: float, close: float, answer: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, space = model.value
        place = space.place()
        rank, columns = place.shape[1], np.ascontiguousarray(place.T)
        wanted = [ix.tokens[i][a:b] for i, a, b in ix.pieces]
        items = np.zeros((len(wanted), rank), np.float32)
        for i, t in enumerate(wanted):
            items[i] = place[ix.find(t)].sum(0)
        norm = np.linalg.norm(items, axis=1, keepdims=True)
        items = np.where(norm > 0, items / np.maximum(norm, 1e-12), 0).astype(np.float32)
        bound = _Bound(ix, wanted, close)
        for batch in batches:
            out: dict[tuple, tuple] = {}
            seen: set[tuple] = set()
            keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, _, words, h in folded(batch.column(2)):
                if not len(h):
                    continue
                block, row = _blocks(words)
                hit = np.flatnonzero((term := ix.find(h)) >= 0)
                found = term[hit]
                x = np.zeros((len(block), rank), np.float32)
                own = np.searchsorted(block, hit, "right") - 1
                for c in range(rank):
                    x[:, c] = np.bincount(own, columns[c][found], len(block))
                runs, edge = bound.blocks(found, own, len(block)), np.searchsorted(row, np.arange(len(words.first)))
                for s, width in enumerate(SCALES):
                    mine = np.flatnonzero(ix.scale == s)
                    if not len(mine):
                        continue
                    at = _windows(row, width)
                    start = block[at]
                    stop = np.minimum(start + width * STEP, words.first[row[at] + 1])
                    # a passage without a term lies nowhere
                    some = np.searchsorted(hit, stop) > np.searchsorted(hit, start)
                    at, start = at[some], start[some]
                    p = _summed(x, row, at, width)
                    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                    some_at = max(64, min(1 << 13, (1 << 25) // len(mine)))
                    for k in range(0, len(at), some_at):
                        w, i = np.divmod(np.flatnonzero(p[k : k + some_at] @ items[mine].T >= cosine), len(mine))
                        first, last = at[k + w], np.minimum(at[k + w] + width, edge[row[at[k + w]] + 1])
                        ok = bound.enough(mine[i], bound.share, runs, first, last)
                        w, i, first, last = w[ok], i[ok], first[ok], last[ok]
                        reach, r = -(-bound.size[mine[i]] // STEP), row[first]
                        ok = bound.enough(mine[i], bound.all, runs, np.maximum(edge[r], first - reach), np.minimum(edge[r + 1], last + reach))
                        w, i = w[ok], i[ok]
                        reach, r, b = bound.size[mine[i]], row[at[k + w]], start[k + w]
                        left = np.searchsorted(hit, np.maximum(words.first[r], b - reach))
                        ok = bound.exact(mine[i], left, np.searchsorted(hit, np.minimum(words.first[r + 1], b + width * STEP + reach)), found)
                        w, i = w[ok], i[ok]
                        like = np.einsum("ij,ij->i", p[k + w], items[mine[i]])
                        for w, i, c in zip(w.tolist(), i.tolist(), like.tolist(), strict=True):
                            r = int(row[at[k + w]])
                            _judge(ix, ix.pieces[mine[i]], words, h, int(start[k + w]), width * STEP, r, c, keys[0][lo + r], keys[1][lo + r], lo, out, seen, copy, close, answer)
            rows = list(out.values())
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "body", "item", "lcs", "cosine", "answer", "begin"])

    return run


def _judge(ix: Index, piece: tuple[int, int, int], words: C.Words, h: np.ndarray, begin: int, width: int, row: int, like: float, doc, body: int, lo: int, out: dict, seen: set, copy: float, close: float, answer: float) -> None:
    item = piece[0]
    if (known := out.get((lo + row, item))) and known[3] >= 0.99:
        return
    want = ix.tokens[item]
    f, e = int(words.first[row]), int(words.first[row + 1])
    first = last = begin
    if piece[2] - piece[1] < len(want):
        # passages of a long item's pieces that begin in the same quarter of its length are judged once, with all words around any of them
        quarter = len(want) // 4
        part = (begin - f) // quarter
        if (lo + row, item, part) in seen:
            return
        seen.add((lo + row, item, part))
        first, last = f + part * quarter, f + (part + 1) * quarter
    a, b = max(f, first - len(want)), min(e, last + width + len(want))
    have = h[a:b]
    # a subsequence is no longer than the words in common
    there = set(have.tolist())
    if sum(x in there for x in want.tolist()) < close * len(want):
        return
    best, at = 0.0, 0
    span = len(want) + len(want) // 2
    for i in range(0, max(1, len(have) - span + len(want) // 4), max(1, len(want) // 4)):
        n, _ = lcs(want, have[i : i + span])
        if n / len(want) > best:
            best, at = n / len(want), a + i - f
    if best < close:
        return
    reply = ix.answers[item]
    told = sum(x in there for x in reply.tolist()) / max(1, len(reply))
    if best >= copy or told >= answer:
        key = (lo + row, item)
        if key not in out or out[key][3] < best:
            out[key] = (doc, body, item, best, like, told, at)


def _rows(docs: DataFrame, benchmark: DataFrame, rank: int, cosine: float, copy: float, close: float, answer: float, common: float, at_once: int) -> DataFrame:
    """_HITS of every row of docs, and the item_id of each."""
    spark = docs.sparkSession
    C.small_batches(spark)
    told = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    bench = benchmark.select("item_id", F.col("text").cast("string").alias("text"), told.alias("answer")).distinct()
    rounds = max(1, -(-bench.count() // at_once))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).select("doc", F.xxhash64("text").alias("body"), "text")
    out = None
    for k in range(rounds):
        # equal texts and answers are in one round
        part = bench.where(F.pmod(F.xxhash64("text", "answer"), F.lit(rounds)) == k) if rounds > 1 else bench
        rows = part.orderBy("item_id", "text", "answer").collect()
        # a text under several item_ids is looked for once for each answer, and found for all of them
        item: dict[tuple, int] = {}
        at = [item.setdefault((r.text, r.answer), len(item)) for r in rows]
        ix = index([(i, *x) for x, i in item.items()], common)
        space = fit_space(d, ix, min(rank, max(1, len(ix.terms))))
        hits = d.mapInArrow(_search(spark.sparkContext.broadcast((ix, space)), cosine, copy, close, answer), _HITS)
        names = spark.createDataFrame([(i, r.item_id) for i, r in zip(at, rows, strict=True)], f"item long, item_id {kind}")
        hits = hits.join(F.broadcast(names), "item")  # one row for each item of the round
        out = hits if out is None else out.unionAll(hits)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 48, cosine: float = 0.4, copy: float = 0.75, close: float = 0.55, answer: float = 0.6, common: float = 0.1, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, item_id, lcs, cosine, answer, begin): documents that hold an item of benchmark (item_id, text; answer if there is one).

    lcs: the share of the item's words in the longest common subsequence with
    some stretch of the document one and a half times as long; answer: the share
    of the answer's words nearby; begin: where about, in words. A pair counts if
    lcs >= copy, or lcs >= close and answer >= `answer`. One row per doc_id and
    item: the best; of equal ones the first in the text. Null or empty texts and
    items match nothing; rows without a doc_id are left out; other columns are
    ignored.
    """
    hits = _rows(docs, benchmark, rank, cosine, copy, close, answer, common, at_once).where("doc is not null")
    best = hits.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(F.max(F.struct("lcs", "cosine", "answer", (-F.col("begin")).alias("b"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.lcs").alias("lcs"), F.col("x.cosine").alias("cosine"), F.col("x.answer").alias("answer"), (-F.col("x.b")).alias("begin"))


def leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, body): doc_id and xxhash64 of the text of the rows of docs that `contaminated` would find, rows without a doc_id too; each once."""
    return _rows(docs, benchmark, 48, 0.4, 0.75, 0.55, 0.6, 0.1, AT_ONCE).select("doc", "body").distinct()

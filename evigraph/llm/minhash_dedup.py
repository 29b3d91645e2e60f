"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Equal sets are one class from
the start. Each class has a sketch of `T` minwise tokens; independent trees
branch the classes recursively: at a node, each of the T tokens is selected with
probability 1 / (BRANCH * T) by a hash of the node's path, and the members go to
the child of the token's value. BRANCH below the threshold keeps a similar
pair's process supercritical; `branchings` counts the trees that the wanted
recall takes, and how often the nodes that branch further start anew, so that the
recall is the same for pairs that meet at the last level only.

Nodes work in two passes. First every node links its members to its smallest
class; these links are verified on full sets and contracted to components, which
closes the nodes of large groups of near copies without looking at their pairs
(a link whose sketches can't come from similar sets, which happens to less than
one similar pair in a million, is not verified here). Where several components
are left, small nodes compare all pairs on full sets and give a star for each
component, so no pairs leave a task. A larger node that one component dominates
would not get smaller by branching: its few other members are compared with all
its members, once for all nodes of that component. Others of up to WIDE blocks are
compared block by block, which deals each member no more often than branching
through the levels would. Larger ones branch further, and what is still large at
the last level is compared block by block too: nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

T = 64  # tokens of a sketch
BRANCH = 0.7
LEAF = 100
LEVELS = 6
BLOCK = 256  # members of a block, where a node is compared in blocks
WIDE = 10  # blocks of a node that is not branched further
COMPARED = 8 << 20  # bytes of folded texts that a task's group compares
TOGETHER = 1_000_000  # links, contracted in each partition, that one task joins up to components; more go through rounds of joins


def recall_at(similarity: float, trees: int, again: int, level: int) -> float:
    """The chance that a pair shares a node of the level in some tree, over the agreement of its sketches, which all levels use; level 2 branches `again` times."""
    miss = 0.0
    for c in range(T + 1):
        q = 1.0
        for at in range(level, 0, -1):
            if at == 2 < level:
                q = 1 - (1 - q) ** again
            q = 1 - (1 - q * c / (BRANCH * T * T)) ** T
        miss += math.comb(T, c) * similarity**c * (1 - similarity) ** (T - c) * (1 - q) ** trees
    return 1 - miss


def branchings(similarity: float, recall: float) -> tuple[int, int]:
    """(trees, again): half the loss that `recall` allows is for the trees down to level 2, the rest for the levels below."""
    trees = again = 1
    while recall_at(similarity, trees, 1, 2) < (1 + recall) / 2:
        trees += 1
    while recall_at(similarity, trees, again, LEVELS + 1) < recall:
        again += 1
    return trees, again


def least_agreement(similarity: float) -> int:
    """Equal tokens that a sketch of similar sets has but with a chance of one in a million."""
    tail = 0.0
    for c in range(T + 1):
        tail += math.comb(T, c) * similarity**c * (1 - similarity) ** (T - c)
        if tail > 1e-6:
            return c
    return T


def shingle_sets(words: C.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; a shorter row is one shingle."""
    h = words.hashes()
    g, at = words.grams(h, k)
    cut = np.searchsorted(at, words.first)
    out = []
    first, counts = words.first.tolist(), words.counts.tolist()
    for i, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
        elif n:
            out.append(np.frombuffer(hashlib.blake2b(h[first[i] : first[i] + n].tobytes(), digest_size=8).digest(), C.U))
        else:
            out.append(np.empty(0, C.U))
    return out


_RNG = np.random.default_rng(29)
_ADD = _RNG.integers(0, 1 << 32, T).astype(np.uint32)
_MUL = _RNG.integers(0, 1 << 31, T).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """T minwise tokens of each set; none may be empty."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.empty(0, C.U)
    out = np.empty((len(sets), T), np.uint32)
    begin = np.append(0, np.cumsum(size))
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + 100_000, "right")) - 1)
        x = (flat[begin[i] : begin[j]] >> C.U(32)).astype(np.uint32)
        at = begin[i:j] - begin[i]
        for t in range(T):
            v = (x ^ _ADD[t]) * _MUL[t]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[i:j, t] = np.minimum.reduceat(v, at)
        i = j
    return out


def _fold(words: C.Words) -> list[bytes]:
    """Each row's words joined by spaces, compressed: a third of what its shingle hashes would take."""
    words = words.squeeze()
    out = []
    for f, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        raw = words.buf[words.starts[f] : words.ends[e - 1]].tobytes() if e > f else b""
        out.append(len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b""))
    return out


_SKETCHED = "id long, body long, n long, print binary, sketch binary, folded binary"


def _sketch(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in C.pieces(batch.column(2), lower=True):
                sets = shingle_sets(words, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sketch = iter(sketches([sets[i] for i in full]))
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                made = [next(sketch).tobytes() if len(s) else None for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, made, _fold(words)))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *columns], ["id", "body", "n", "print", "sketch", "folded"])

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), T)


def _branch(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For members at nodes (path): the member's index and the path of each child."""
    nodes, of = np.unique(path, return_inverse=True)
    row, child = [], []
    bar = C.U(int(2**64 / (BRANCH * T)))
    for t in range(T):
        draw = C.mix(nodes ^ C.U((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pick = np.flatnonzero((draw < bar)[of])
        row.append(pick)
        child.append(C.mix(draw[of[pick]] + C.mix(tokens[pick, t].astype(C.U) + C.U(t << 32))))
    return np.concatenate(row), np.concatenate(child)


def _roots(trees: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(2))
            for r in range(trees):
                row, child = _branch(np.full(len(tokens), C.mix(np.array([r + 1], C.U))[0]), tokens)
                # strangers may share one token in a large corpus, so no node of the first level is compared
                again, child = _branch(child, tokens[row])
                at = pa.array(row[again])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["node", "id", "bytes"])

    return run


def _deeper(again: int) -> Callable:
    """The children of nodes; each node branches so many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, tokens = batch.column(0).to_numpy().view(C.U), _tokens(batch.column(4))
            for r in range(again):
                row, child = _branch(C.mix(path + C.U(r)) if r else path, tokens)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(i).take(at) for i in (1, 2, 3))], ["node", "id", "bytes", "comp"])

    return run


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = (_tokens(batch.column(2)) == _tokens(batch.column(3))).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])


def _unfold(values: list[bytes], k: int) -> list[np.ndarray]:
    raw = [pa.decompress(v[8:], int.from_bytes(v[:8], "little"), codec="zstd", asbytes=True) if len(v) > 8 else b"" for v in values]
    out = []
    for _, _, words in C.pieces(pa.array(raw, pa.binary()), lower=True):
        out += shingle_sets(words, k)
    return out


def _verify(k: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                distinct = list(dict.fromkeys(part.column(2).to_pylist() + part.column(3).to_pylist()))
                sets = dict(zip(distinct, _unfold(distinct, k), strict=True))
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = sets[x], sets[y]
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    return run


def similar(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with 100 * intersection >= percent * union, by products of incidence matrices of bounded width."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    place = np.cumsum(often > 1) - 1
    column, row = place[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        both += m @ m.T
    return np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))


def _compare(k: int, percent: int) -> Callable:
    """The nodes of a bucket, each exhaustively on full sets; links leave as a star for each component."""

    def run(group: pa.Table) -> pa.Table:
        node, ids = group.column("node").to_numpy(), group.column("id").to_numpy()
        names, at = np.unique(ids, return_index=True)
        folded = group.column("folded").take(pa.array(at)).to_pylist()
        sets: dict[int, np.ndarray] = {}
        for i in range(0, len(folded), 512):
            sets.update(zip(names[i : i + 512].tolist(), _unfold(folded[i : i + 512], k), strict=True))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        order = np.argsort(node, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            who = ids[part]
            x, y = similar([sets[i] for i in who.tolist()], percent) if len(who) > 1 else ((), ())
            if len(x):
                v, root = C._forest(who[x], who[y])
                a.append(v)
                b.append(root)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: int, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, a < b) that are similar: sizes and sketches first, then full sets."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    text = lambda c: texts.select(F.col("id").alias(c), F.col("folded").alias(f"{c}_text"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    near = near.select("a", "b", "a_sketch", "b_sketch").mapInArrow(lambda batches: _alike(batches, least), "a long, b long")
    full = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "a_text", "b_text")
    return full.mapInArrow(_verify(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, recall: float = 0.9999) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text), as `grouped` has them."""
    return grouped(docs, k, percent, recall).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int = 5, percent: int = 75, recall: float = 0.9999) -> DataFrame:
    """(doc, body, n_shingles, component_id, kept) for every row of docs (doc_id, text): doc is its doc_id, body the xxhash64 of its text.

    A-Z is lower-cased; a set is the distinct shingles of `k` words, or the whole
    sequence if there are fewer words; sets link if 100 * intersection >= percent
    * union, so a pair at exactly that share links. A null or empty text has an
    empty set and links with nothing. Rows that share a doc_id are told apart by
    their texts and each get a result row. A null doc_id links with nothing, gets
    null as its component and is kept. Other columns are ignored; no rows, no
    result.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    base = C.scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    all_sets = C.settle(docs.mapInArrow(_sketch(k), _SKETCHED), f"{base}/sets")
    known = all_sets.where("print is not null and id is not null")
    # rows that share an id may lead several classes, so classes have names of their own; of equal sets any sketch and text will do
    classes = known.groupBy("print").agg(F.min("id").alias("doc"), *(F.first(c).alias(c) for c in ("n", "sketch", "folded")))
    classes = C.settle(classes.select(F.xxhash64("print").alias("id"), "doc", "n", F.length("folded").cast("long").alias("bytes"), "print", "sketch", "folded"), f"{base}/classes")
    similarity = percent / 100
    (trees, again), least = branchings(similarity, recall), least_agreement(similarity)
    roots = C.settle(classes.select("id", "bytes", "sketch").mapInArrow(_roots(trees), "node long, id long, bytes long"), f"{base}/roots")
    shared = roots.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
    member = C.settle(roots.join(shared, "node"), f"{base}/members")
    C.discard(spark, f"{base}/roots")

    # full texts of every class that shares a node, moved once
    texts = C.settle(classes.select("id", "folded").join(member.select("id").distinct(), "id", "left_semi"), f"{base}/texts")

    first = member.where("id <> low").selectExpr("low as a", "id as b")
    links = C.settle(_verified(first, classes, texts, least, k, percent), f"{base}/first")
    comp = C.components(links, together=TOGETHER)

    level = member.select("node", "id", "bytes").join(comp, "id", "left").selectExpr("node", "id", "bytes", "coalesce(component, id) as comp")
    found = dense = None
    for depth in range(1, LEVELS + 1):
        per = level.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node")
        mixed = per.agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("node", "size", "top")
        level = C.settle(level.join(mixed, "node"), f"{base}/level{depth}")
        last = depth == LEVELS
        # a node is compared as its blocks and their pairs
        here = level if last else level.where(f"size <= {LEAF} or (2 * top.c < size and size <= {WIDE * BLOCK})")
        small = here.withColumn("blocks", F.ceil(F.col("size") / BLOCK))
        small = small.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        small = small.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "id", "bytes")
        found = small if found is None else found.unionAll(small)
        if last:
            break
        large = level.where(f"size > {LEAF}")
        part = large.where("2 * top.c >= size").selectExpr("top.comp as c", "id", "bytes", "comp <> top.comp as odd")
        dense = part if dense is None else dense.unionAll(part)
        large = large.where(f"2 * top.c < size and size > {WIDE * BLOCK}")
        if large.isEmpty():
            break
        level = large.join(classes.select("id", "sketch"), "id").select("node", "id", "bytes", "comp", "sketch").mapInArrow(_deeper(again if depth == 1 else 1), "node long, id long, bytes long, comp long")
    # nodes that one component dominates: whoever is not of it against all members, once for all such nodes, in pairs of blocks
    dense = C.settle(dense.distinct(), f"{base}/dense")
    sizes = dense.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).alias("all"), F.ceil(F.sum(F.col("odd").cast("long")) / BLOCK).alias("odds")).where("odds > 0")
    dense = dense.join(sizes, "c").withColumn("h", F.xxhash64("id"))
    left = dense.where("odd").selectExpr("c", "id", "bytes", "pmod(h, odds) as x", "explode(sequence(0L, all - 1)) as y")
    right = dense.selectExpr("c", "id", "bytes", "odd", "pmod(h, odds) as own", "explode(sequence(0L, odds - 1)) as x", "pmod(h, all) as y")
    right = right.where("not (odd and x = own)").drop("odd", "own")  # left has those
    found = found.unionAll(left.unionAll(right.select(*left.columns)).select(F.xxhash64("c", "x", "y", F.lit("dense")).alias("node"), "id", "bytes"))
    found = C.settle(found, f"{base}/found")
    # as many groups as keep the texts of one within COMPARED bytes, but for a node of larger texts
    total = found.agg(F.sum("bytes")).first()[0] or 0
    groups = max(16 * C.shuffle_partitions(spark), -(-total // COMPARED))
    met = found.join(texts.select("id", "folded"), "id").select(F.pmod("node", F.lit(groups)).alias("bucket"), "node", "id", "folded")
    more = C.settle(met.groupBy("bucket").applyInArrow(_compare(k, percent), "a long, b long"), f"{base}/second")
    comp = C.components(links.unionAll(more), together=TOGETHER)
    for name in ("texts", "found", "dense", "members", "first", "second", *(f"level{i}" for i in range(1, LEVELS + 1))):
        C.discard(spark, f"{base}/{name}")

    # classes are named by hashes; a component is called after its smallest doc_id
    named = classes.select("print", "id", "doc").join(comp, "id", "left").selectExpr("print", "doc", "coalesce(component, id) as component")
    low = named.groupBy("component").agg(F.min("doc").alias("low"))
    label = named.join(low, "component").select("print", "low")
    label = C.settle(label, f"{base}/labels")
    C.discard(spark, f"{base}/classes")
    out = all_sets.select(F.col("id").alias("doc"), "body", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("print")).alias("print"))
    out = out.join(label, "print", "left").selectExpr("doc", "body", "n_shingles", "coalesce(low, doc) as component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))

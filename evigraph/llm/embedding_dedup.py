"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every unit vector is projected on `m` random directions. The projections are
used in `tables` lists: each list sorts the vectors of a cell (the first
projections of the list, rounded with a random offset) by one further
projection, and two vectors collide in a list where they lie within a window of
`half` around each other. For a pair so found, the window collisions over all
`m` projections are counted, and pairs whose count reaches a threshold are
verified by the cosine in double precision.

All numbers are calibrated, not guessed, for every dimension there is:
`calibrate` takes the least number of lists that reaches the wanted recall on
random pairs exactly at the threshold (closer pairs do better), and a count that
such a pair misses with a chance of less than 1e-9. The number of cell
projections follows log(n): in a list sorted without cells, a window holds a
fixed share of all vectors, so the windows of all lists would grow with n^2;
cells keep strangers out of the window.

A pair is counted in the first list in which it collides, so links are counted
where they are found and no pairs leave a task. The windows of a sorted cell are
taken many at a time, as arrays: a cell gives one partial count
for each vector and a spanning star for the components. Equal vectors are one
class throughout. A cell beyond `block` vectors is split into blocks, each pair
of blocks being a task's group of its own, so nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CELL = 2.0  # width of a cell
HALF = 0.9  # half a window
M = 128  # projections
MOST_LISTS = 4096
GROUP = 2048  # vectors that meet in a group, more or less
PAIRS = 1 << 17  # pairs that are looked at at once
_NONE = 2**63 - 1  # stands for a null vec_id


@lru_cache(64)
def calibrate(n: int, threshold: float, recall: float, dim: int = 64, m: int = M) -> tuple[int, int, int, float]:
    """(cell projections of a list, lists, count, measured recall) for n vectors.

    The lists are counted on 20,000 random pairs exactly at the threshold, with the very directions in use.
    """
    d = math.sqrt(2 - 2 * threshold)
    z = np.abs(np.random.default_rng(7).standard_normal(200_000))
    far = np.clip(1 - z * math.sqrt(2) / CELL, 0, 1).mean()
    k = min(m - 1, max(2, math.ceil(math.log(10 * max(n, 2)) / -math.log(far))))
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((20_000, dim)))
    u = rng.standard_normal(x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x) if dim > 1 else 0 * x
    y = unit(threshold * x + math.sqrt(1 - threshold**2) * u)
    own, got, lists = _Lists(dim, k, MOST_LISTS, m), np.zeros(len(x), bool), 0
    p, q = x @ own.directions, y @ own.directions
    # in few dimensions directions are alike, and counts spread more than those of independent ones
    inside, count, tail = math.erf(HALF / d / math.sqrt(2)), m, 0.0
    for c in range(m + 1):
        tail += math.comb(m, c) * inside**c * (1 - inside) ** (m - c)
        if tail > 1e-9:
            count = c
            break
    met = (np.abs(p - q) <= HALF).sum(1)
    if met.min() < count:
        count = 0  # verify whatever collides
    while got.mean() < recall:
        if lists >= MOST_LISTS:
            raise RuntimeError(f"{lists} lists reach a recall of {got.mean():.4f} in {dim} dimensions, not {recall}")
        left = np.flatnonzero(~got)
        part, lists = slice(lists, lists + 8), lists + 8
        last = own.picks[part, -1]
        got[left] = ((own.cells(p[left], part) == own.cells(q[left], part)) & (np.abs(p[left][:, last] - q[left][:, last]) <= HALF)).any(1)
    return k, lists, count, float(got.mean())


class _Lists:
    """The fixed directions, offsets and lists for vectors of one dimension; the same on every machine."""

    def __init__(self, dim: int, k: int, lists: int, m: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim, k, m])
        self.directions = rng.standard_normal((dim, m))
        self.picks = np.array([rng.permutation(m)[: k + 1] for _ in range(lists)])
        self.offsets = np.random.default_rng([seed, 1]).random((lists, k)) * CELL
        self.salt = np.random.default_rng([seed, 2]).integers(1, 2**63, (lists, k)).astype(C.U) | C.U(1)

    def cells(self, p: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        """A 64-bit name of each vector's cell in each list, or in some lists."""
        at = np.floor((p[:, self.picks[part, :-1]] + self.offsets[part]) / CELL).astype(np.int64).view(C.U)
        return C.mix((at * self.salt[part]).sum(2, dtype=C.U) + np.arange(len(self.picks), dtype=C.U)[part])


@lru_cache(16)
def _lists(dim: int, k: int, lists: int, m: int) -> _Lists:
    """Made once in a process."""
    return _Lists(dim, k, lists, m)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(plans: dict[int, tuple[int, int, int]], m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.asarray(column.value_lengths())
            for dim in np.unique(size).tolist():
                k, lists, _ = plans[dim]
                pick = np.flatnonzero(size == dim)
                for i in range(0, len(pick), 1024):
                    rows = pick[i : i + 1024]
                    x = unit(_matrix(column.take(pa.array(rows))))
                    own = _lists(dim, k, lists, m)
                    cell = own.cells(x @ own.directions)
                    ids = batch.column(0).take(pa.array(np.repeat(rows, lists)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), pa.array(np.tile(np.arange(lists, dtype=np.int32), len(rows))), ids], ["cell", "list", "id"])

    return run


def _ahead(cell: np.ndarray, along: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of values sorted within their cells: whoever lies in i's window ahead (the window behind is another's window ahead), PAIRS or one window at a time."""
    n = len(along)
    # cells side by side on one line, further apart than any window
    apart = float(np.ptp(along)) + 2 * HALF + 1 if n else 1.0
    line = cell * apart + along
    count = np.searchsorted(line, line + HALF + 1e-6, "right") - np.arange(n) - 1
    upto = np.append(0, np.cumsum(count))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[lo:hi] - upto[lo], count[lo:hi])
        inside = along[j] - along[i] <= HALF
        yield i[inside], j[inside]
        lo = hi


def _colliding(p: np.ndarray, i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """Indices of the pairs with `count` window collisions among the projections (projections by vectors)."""
    met, left = np.zeros(len(i), np.int64), np.arange(len(i))
    for lo in range(0, len(p) if count else 0, 16):
        part = p[lo : lo + 16]
        for row in part:
            met += np.abs(row[i] - row[j]) <= HALF
        may = np.flatnonzero(met + (len(p) - lo - len(part)) >= count)
        if len(may) < len(i):
            i, j, met, left = i[may], j[may], met[may], left[may]
    return left


def _meet(plans: dict[int, tuple[int, int, int]], m: int, threshold: float) -> Callable:
    """Some cells of a list, or pairs of blocks of a large one: partial link counts, and a star for each component."""

    def run(group: pa.Table) -> pa.Table:
        t = group.column("list")[0].as_py()
        ids, copies, block = (group.column(c).to_numpy() for c in ("id", "copies", "block"))
        one, two = group.column("one").to_numpy(), group.column("two").to_numpy()
        cell = np.unique(np.stack([group.column("cell").to_numpy(), one, two]), axis=1, return_inverse=True)[1].ravel()
        raw = group.column("embedding").combine_chunks()
        size = np.asarray(raw.value_lengths())
        links, root_of = np.zeros(len(ids), np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))
        for dim in np.unique(size).tolist():
            k, lists, count = plans[dim]
            rows = np.flatnonzero(size == dim)
            x = unit(_matrix(raw.take(pa.array(rows))))
            own = _lists(dim, k, lists, m)
            p = x @ own.directions
            order = np.lexsort((p[:, own.picks[t, -1]], cell[rows]))
            rows, x, p = rows[order], x[order], p[order]
            turned, earlier = np.ascontiguousarray(p.T), {}
            for i, j in _ahead(cell[rows], turned[own.picks[t, -1]]):
                other = (one[rows[i]] == two[rows[i]]) | (block[rows[i]] != block[rows[j]])
                i, j = i[other], j[other]
                # an earlier list has a pair that shares a cell and a window there
                for lo in range(0, t, 8):
                    if not len(i):
                        break
                    if lo not in earlier:
                        earlier[lo] = np.ascontiguousarray(own.cells(p, slice(lo, min(t, lo + 8))).T)
                    known = np.zeros(len(i), bool)
                    for name, last in zip(earlier[lo], own.picks[lo : min(t, lo + 8), -1].tolist(), strict=True):
                        same = np.flatnonzero(name[i] == name[j])
                        known[same[np.abs(turned[last][i[same]] - turned[last][j[same]]) <= HALF]] = True
                    i, j = i[~known], j[~known]
                near = _colliding(turned, i, j, count)
                i, j = i[near], j[near]
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = rows[i[near]], rows[j[near]]
                if len(i):
                    links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    root_of = C._forest(np.concatenate([root_of[0], ids[i]]), np.concatenate([root_of[1], ids[j]]))
        has = np.flatnonzero(links > 0)
        at = np.minimum(np.searchsorted(root_of[0], ids[has]), max(0, len(root_of[0]) - 1))
        star = np.where(root_of[0][at] == ids[has], root_of[1][at], ids[has]) if len(root_of[0]) else ids[has]
        return pa.Table.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(star, pa.int64())], ["id", "links", "component"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, block: int = 1500) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Two vectors link if their cosine in double precision is at least
    `threshold`; vectors of different lengths never do. A null, empty or zero
    vector, or one with null or non-finite components, links with nothing. Equal
    vectors are links of each other. Rows that share a vec_id are told apart
    only by their vectors: each is a vector of its own in n_links, and the
    result has one row for each. A null vec_id gets null as its component and
    is kept, and counts as a link of others. Other columns are ignored.
    """
    spark = vectors.sparkSession
    C.small_batches(spark)
    base = C.scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    good = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    same = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0 is 0
    v = v.withColumn("hash", F.when(F.expr(good), F.struct(F.xxhash64(same).alias("x"), F.xxhash64(F.reverse(same), F.lit(1)).alias("y"))))
    v = v.withColumn("id", F.coalesce("vec_id", F.lit(_NONE)))
    valid = v.where("hash is not null")
    # one class for equal vectors; minima and counts are aggregated before the shuffle
    classes = valid.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    lead = valid.select("hash", "id", "embedding").join(classes, ["hash", "id"]).dropDuplicates(["hash"])
    # rows with one vec_id and two vectors make two classes, so classes have names of their own
    lead = C.settle(lead.withColumn("name", F.xxhash64("hash")), f"{base}/lead")
    # one plan for each dimension that there is
    sizes = lead.groupBy(F.size("embedding").alias("dim")).count().collect()
    plans = {r.dim: calibrate(1 << r["count"].bit_length(), threshold, recall, r.dim)[:3] for r in sizes}
    dealt = C.settle(lead.select("name", "embedding").mapInArrow(_deal(plans, M), "cell long, list int, id long"), f"{base}/dealt")
    full = C.settle(dealt.groupBy("cell", "list").agg(F.count("*").alias("n")).where("n > 1"), f"{base}/full")
    # cells meet by the thousand vectors; one of more than `block` is dealt out as the pairs of its blocks, each a group of its own
    total = full.where(f"n <= {block}").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // (GROUP * max(x[1] for x in plans.values())))) if plans else 1
    member = dealt.join(full.hint("merge"), ["cell", "list"]).withColumn("nb", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")))
    pair = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    pair = pair.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    pair = pair.withColumn("part", F.when(F.col("nb") > 1, F.xxhash64("cell", "one", "two")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(parts))))
    pair = pair.select("id", "cell", "list", "block", "one", "two", "part").join(lead.select(F.col("name").alias("id"), "copies", "embedding").hint("merge"), "id")
    part = pair.groupBy("list", "part").applyInArrow(_meet(plans, M, threshold), "id long, links long, component long")
    part = C.settle(part, f"{base}/part")
    C.discard(spark, f"{base}/dealt")
    C.discard(spark, f"{base}/full")
    links = part.groupBy("id").agg(F.sum("links").alias("links"))
    comp = C.components(part.where("id <> component").selectExpr("id as a", "component as b"))
    # names are hashes; a component is called after its smallest vec_id
    low = comp.join(lead.select(F.col("name").alias("id"), F.col("id").alias("vec")), "id").groupBy("component").agg(F.min("vec").alias("low"))
    low = comp.join(low, "component").select("id", "low")
    known = lead.select("hash", F.col("name").alias("id"), "copies", F.col("id").alias("own")).join(links, "id", "left").join(low, "id", "left")
    known = known.selectExpr("hash", "copies - 1 + coalesce(links, 0L) as n_links", "coalesce(low, own) as low")
    out = v.join(known, "hash", "left").selectExpr("vec_id", "coalesce(n_links, 0L) as n_links", f"if(vec_id is null, null, coalesce(nullif(low, {_NONE}L), vec_id)) as component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

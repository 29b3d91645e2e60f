"""Traversal, components, centrality and communities over edges (s, o, w)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import settle


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "out", most: int | None = None) -> DataFrame:
    """(root, node, distance) from seeds (root): frontier joins, visited nodes anti-joined, so cycles cost nothing.

    direction: out, in or both. depth: None goes on until nothing is new. most:
    keep so many nodes per root, by distance and node. Edges and every level are
    written to the shared folder, so no level is ever computed twice.
    """
    step = {"out": edges.selectExpr("s as x", "o as y"), "in": edges.selectExpr("o as x", "s as y"), "both": edges.selectExpr("s as x", "o as y").unionAll(edges.selectExpr("o as x", "s as y"))}[direction].distinct()
    front = seeds.select("root", F.col("root").alias("node")).distinct()
    if depth is None or depth > 1:
        step, front = settle(step), settle(front)
    seen = front.withColumn("distance", F.lit(0).cast("long"))
    d = 0
    while depth is None or d < depth:
        d += 1
        reached = front.join(step, front.node == step.x).select("root", F.col("y").alias("node")).distinct()
        front = reached.join(seen, ["root", "node"], "left_anti")
        if depth is None or d < depth:
            front = settle(front)
            if front.isEmpty():
                break
        seen = seen.unionAll(front.withColumn("distance", F.lit(d).cast("long")))
    if most:
        rank = F.row_number().over(Window.partitionBy("root").orderBy("distance", "node"))
        seen = seen.withColumn("r", rank).where(F.col("r") <= most).drop("r")
    return seen


def confident(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "in") -> DataFrame:
    """(root, node, distance, confidence): as bfs, with the largest product of weights (s, o, w) among the shortest paths."""
    x, y = ("s", "o") if direction == "out" else ("o", "s")
    step = settle(edges.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.max("w").cast("double").alias("w")))
    front = seeds.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("distance"), F.lit(1.0).alias("confidence")).distinct()
    seen = front
    for d in range(1, depth + 1):
        reached = front.join(step, front.node == step.x).groupBy("root", F.col("y").alias("node")).agg(F.max(F.col("confidence") * F.col("w")).alias("confidence"))
        front = settle(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).cast("long").alias("distance"), "confidence"))
        seen = seen.unionAll(front)
    return seen


def chains(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(root, path, length, confidence): all simple forward paths of one to `depth` edges; confidence is the product of weights."""
    now = seeds.select("root", F.array("root").alias("path"), F.col("root").alias("node"), F.lit(1.0).alias("confidence"))
    out = None
    for d in range(1, depth + 1):
        now = now.join(edges, now.node == edges.s).where(~F.array_contains("path", F.col("o")))
        now = now.select("root", F.concat("path", F.array("o")).alias("path"), F.col("o").alias("node"), (F.col("confidence") * F.col("w")).alias("confidence"))
        part = now.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.lit(d).cast("long").alias("length"), F.round("confidence", 6).alias("confidence"))
        out = part if out is None else out.unionAll(part)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable without regard to direction; label minima with a jump to the label's label each round.

    Raises if labels still move after so many rounds, which takes a path of about 2^rounds nodes.
    """
    both = settle(edges.selectExpr("s as x", "o as y").unionAll(edges.selectExpr("o as x", "s as y")).distinct())
    label = settle(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).selectExpr("x as node", "l"))
    for _ in range(rounds):
        near = both.join(label, both.y == label.node).groupBy("x").agg(F.min("l").alias("m")).selectExpr("x as node", "m")
        step = label.join(near, "node").select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        up = step.selectExpr("node as l", "l as ll")
        new = settle(step.join(up, "l", "left").selectExpr("node", "least(l, coalesce(ll, l)) as l", "old"))
        label = new.select("node", "l")
        if new.where("l < old").isEmpty():
            return label.withColumnRenamed("l", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, degree): distinct neighbours each way, and without regard to direction."""
    e = edges.where("s <> o").select("s", "o").distinct()
    ends = e.selectExpr("s as node", "o as other", "1 as go", "0 as come").unionAll(e.selectExpr("o", "s", "0", "1"))
    return ends.groupBy("node", "other").agg(F.max("go").alias("go"), F.max("come").alias("come")).groupBy("node").agg(F.sum("come").alias("fan_in"), F.sum("go").alias("fan_out"), F.count("*").alias("degree"))


def quality(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (communities, modularity, coverage) of partition (node, c) over undirected weighted edges."""
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    e = edges.where("s <> o").join(p("s"), "s").join(p("o"), "o")
    tot = e.select(F.col("c_s").alias("c"), "w").unionAll(e.select("c_o", "w")).groupBy("c").agg(F.sum("w").alias("tot"))
    inside = e.where("c_s = c_o").groupBy(F.col("c_s").alias("c")).agg(F.sum("w").alias("inside"))
    m = e.agg(F.sum("w").alias("m"))
    each = tot.join(inside, "c", "left").join(F.broadcast(m)).select(F.coalesce("inside", F.lit(0)).alias("i"), "tot", "m")
    return each.agg(F.count("*").alias("communities"), F.round(F.sum(F.col("i") / F.col("m") - (F.col("tot") / (2.0 * F.col("m"))) ** 2), 6).alias("modularity"), F.round(F.sum("i") / F.max("m"), 6).alias("coverage"))


# ------------------------------------------------------------------- kernels
# What follows is sequential by nature, or needs the adjacency at hand. Edges are
# dealt out by what hangs together, and a task has one part at a time; the driver
# has counts, and the sources of betweenness.

MAX_EDGES = 4_000_000
# Components of so many edges are a part by themselves; smaller ones share parts of about as many.
PART_EDGES = 1 << 15
# So many roots of a traversal share a task, unless that takes more tasks than run at once.
TASK_ROOTS = 1 << 13


@dataclass
class Packed:
    """An undirected graph as compressed rows: the neighbours of node i are to[at[i]:at[i + 1]], in order, with weights."""

    names: np.ndarray
    at: np.ndarray
    to: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.names)

    @property
    def own(self) -> np.ndarray:
        """The node that each entry belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.at))


def coded(s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names in order, s and o as their indexes)."""
    names = np.union1d(s, o)
    return names, np.searchsorted(names, s), np.searchsorted(names, o)


def packed(s: np.ndarray, o: np.ndarray, w: np.ndarray) -> Packed:
    """Weights of parallel edges add up, without regard to direction; loops are left out."""
    keep = s != o
    names, x, y = coded(s[keep], o[keep])
    n = max(1, len(names))
    pair = np.concatenate([x * n + y, y * n + x])
    by = np.argsort(pair, kind="stable")
    pair = pair[by]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    weight = np.add.reduceat(np.concatenate([w[keep], w[keep]]).astype(float)[by], first) if len(first) else np.empty(0)
    pair = pair[first]
    return Packed(names, np.searchsorted(pair, np.arange(len(names) + 1) * n), (pair % n).astype(np.int32), weight)


def gather(edges: DataFrame, most: int = MAX_EDGES) -> pd.DataFrame:
    """Edges (s, o, w), parallel ones added up, on the driver: at most `most` of them. For small graphs; no operator here needs it."""
    own = edges.where("s <> o").groupBy("s", "o").agg(F.sum("w").alias("w")).limit(most + 1).toPandas()
    if len(own) > most:
        raise ValueError(f"more than {most} edges; this needs the whole graph at once")
    return own


def deal(edges: DataFrame) -> DataFrame:
    """(s, o, w, part): edges with parallel ones added up, without loops; those that hang together have one part. Edges that have one stay as they are."""
    if "part" in edges.columns:
        return edges
    own = settle(edges.where("s <> o").groupBy(F.col("s").cast("long").alias("s"), F.col("o").cast("long").alias("o")).agg(F.sum("w").alias("w")))
    own = settle(own.join(components(own).withColumnRenamed("node", "s"), "s").select("s", "o", "w", "component"))
    size = own.groupBy("component").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") >= PART_EDGES).select("component", F.col("component").alias("alone"))  # one for so many edges at most
    shared = 1 + own.count() // PART_EDGES
    return own.join(F.broadcast(large), "component", "left").select("s", "o", "w", F.coalesce("alone", F.pmod(F.xxhash64("component"), F.lit(shared))).alias("part"))


def members(dealt: DataFrame) -> DataFrame:
    """(node, part) of the nodes with edges."""
    return dealt.select(F.col("s").alias("node"), "part").unionAll(dealt.select("o", "part")).distinct()


def _together(df: DataFrame, *key: str):
    """df grouped by the key, dealt to several tasks a core whatever its size."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *key).groupBy(*key)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _graph(t: pa.Table) -> Packed:
    return packed(*_columns(t, "s", "o", "w"))


def _rows(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the rows `of`, size of each)."""
    size = at[of + 1] - at[of]
    return np.repeat(at[of] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def _dependencies(g: Packed, source: int) -> np.ndarray:
    """How much the shortest paths from source depend on each node, level by level."""
    n = len(g)
    depth, paths = np.full(n, -1, np.int32), np.zeros(n)
    depth[source], paths[source] = 0, 1.0
    levels, front = [], np.array([source])
    while len(front):
        entry, size = _rows(g.at, front)
        u, v = np.repeat(front.astype(np.int32), size), g.to[entry]
        depth[v[depth[v] < 0]] = len(levels) + 1
        ahead = depth[v] == len(levels) + 1
        u, v = u[ahead], v[ahead]
        np.add.at(paths, v, paths[u])
        levels.append((u, v))
        front = np.unique(v)
    owed = np.zeros(n)
    for u, v in reversed(levels):
        np.add.at(owed, u, paths[u] / np.maximum(paths[v], 1e-300) * (1 + owed[v]))
    owed[source] = 0
    return owed


def every(nodes: DataFrame, step: int) -> DataFrame:
    """Of nodes (node, ...) in order, each step-th from the first; ranges are counted before ranks are taken within them."""
    if step == 1:
        return nodes
    ranges = settle(nodes.repartitionByRange("node").withColumn("range", F.spark_partition_id()))
    n = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one for each task
    before = [(k, sum(v for x, v in n.items() if x < k)) for k in n]
    before = nodes.sparkSession.createDataFrame(before, "range int, before long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("node")) - 1 + F.col("before")
    return ranges.join(F.broadcast(before), "range").withColumn("rank", rank).where(F.col("rank") % step == 0).drop("range", "before", "rank")


def betweenness(edges: DataFrame, sources: int = 500, exact: int = 1000, nodes: int | None = None) -> DataFrame:
    """(node, score): Brandes over unweighted undirected edges; a task has a part and some of its sources.

    Above `exact` nodes, from evenly spaced sources, scaled up. Scores are
    shares of (n - 1)(n - 2), n being `nodes`, or the number of nodes with edges.
    """
    spark = edges.sparkSession
    e = deal(edges)
    own = settle(members(e))
    n = own.count()
    step = 1 if n <= exact else max(1, n // sources)
    asked: dict[int, list[int]] = {}
    for r in every(own, step).collect():  # fewer than exact or 2 * sources
        asked.setdefault(r.part, []).append(r.node)
    picked = sum(map(len, asked.values()))
    per = max(1, -(-picked // spark.sparkContext.defaultParallelism))
    dealt = {(p, k): x[k * per : (k + 1) * per] for p, x in asked.items() for k in range(-(-len(x) // per))}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        g = _graph(t)
        total = np.zeros(len(g))
        for i in np.searchsorted(g.names, dealt[key[0].as_py(), key[1].as_py()]).tolist():
            total += _dependencies(g, i)
        some = total > 0
        return pa.table({"node": g.names[some], "x": total[some]})

    turns = spark.createDataFrame(list(dealt), "part long, turn int")
    x = _together(e.join(F.broadcast(turns), "part"), "part", "turn").applyInArrow(run, "node long, x double").groupBy("node").agg(F.sum("x").alias("x"))
    size = nodes or n
    scale = (n / max(1, picked)) / max(1, (size - 1) * (size - 2))
    return own.select("node").join(x, "node", "left").select("node", F.round(F.coalesce("x", F.lit(0.0)) * scale, 6).alias("score"))


def preorder(g: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in the order of a depth-first search, parent of each node or -1)."""
    n = len(g)
    parent, seen, order = np.full(n, -1), bytearray(n), []
    at, to, go = g.at.tolist(), memoryview(np.ascontiguousarray(g.to)), g.at.tolist()
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = 1, [root]
        order.append(root)
        while stack:
            v = stack[-1]
            k, end = go[v], at[v + 1]
            while k < end and seen[to[k]]:
                k += 1
            go[v] = k
            if k == end:
                stack.pop()
                continue
            u = to[k]
            seen[u], parent[u] = 1, v
            order.append(u)
            stack.append(u)
    return np.array(order, np.int64), parent


def cut_sets(g: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(articulation points, bridges as pairs): Schmidt's chain decomposition of a depth-first forest.

    Every edge outside the forest opens a chain at its upper end, which climbs
    from its lower end until it meets a node that an earlier chain has visited.
    A forest edge that no chain climbs is a bridge. Cut nodes are the ends of
    bridges that have other neighbours, and the starts of chains that close a
    cycle, but for a component's first chain.
    """
    order, parent = preorder(g)
    rank, root = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    rank[order] = np.arange(len(order))
    root[order] = order[np.maximum.accumulate(np.where(parent[order] < 0, np.arange(len(order)), 0))]
    own = g.own
    back = np.flatnonzero((rank[g.to] > rank[own]) & (parent[g.to] != own))
    back = back[np.argsort(rank[own[back]], kind="stable")]
    visited, climbed, up = bytearray(len(g)), bytearray(len(g)), parent.tolist()
    points, first = set(), set()
    for v, u, r in zip(own[back].tolist(), g.to[back].tolist(), root[own[back]].tolist(), strict=True):
        visited[v] = 1
        while not visited[u]:
            visited[u] = climbed[u] = 1
            u = up[u]
        if u == v:
            (points if r in first else first).add(v if r in first else r)
    lower = np.flatnonzero((parent >= 0) & (np.frombuffer(climbed, np.uint8) == 0))
    ends = np.unique(np.concatenate([lower, parent[lower]]))
    points.update(ends[np.diff(g.at)[ends] > 1].tolist())
    return np.array(sorted(points), np.int64), np.sort(np.stack([lower, parent[lower]], 1), axis=1)


def cuts(edges: DataFrame) -> DataFrame:
    """(kind, a, b): articulation points (b null) and bridges (a < b)."""

    def run(t: pa.Table) -> pa.Table:
        g = _graph(t)
        points, bridges = (g.names[x] for x in cut_sets(g))
        kind = ["articulation"] * len(points) + ["bridge"] * len(bridges)
        b = pa.concat_arrays([pa.nulls(len(points), pa.int64()), pa.array(bridges[:, 1])])
        return pa.table({"kind": pa.array(kind, pa.string()), "a": np.concatenate([points, bridges[:, 0]]), "b": b})

    return _together(deal(edges), "part").applyInArrow(run, "kind string, a long, b long")


def _strong(n: int, s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest of its strongly connected component; two depth-first searches, the second against the edges."""

    def rows(x: np.ndarray, y: np.ndarray) -> tuple[list[int], memoryview]:
        by = np.argsort(x, kind="stable")
        return np.searchsorted(x[by], np.arange(n + 1)).tolist(), memoryview(y[by].astype(np.int32))

    at, to = rows(s, o)
    seen, go, finished = bytearray(n), list(at), []
    for start in range(n):
        stack = [] if seen[start] else [start]
        seen[start] = 1
        while stack:
            v = stack[-1]
            k, end = go[v], at[v + 1]
            while k < end and seen[to[k]]:
                k += 1
            go[v] = k
            if k == end:
                finished.append(stack.pop())
            else:
                seen[to[k]] = 1
                stack.append(to[k])
    at, to = rows(o, s)
    label = [-1] * n
    for start in reversed(finished):
        if label[start] >= 0:
            continue
        label[start], group = start, [start]
        for v in group:
            for u in to[at[v] : at[v + 1]]:
                if label[u] < 0:
                    label[u] = start
                    group.append(u)
        low = min(group)
        if low != start:
            for v in group:
                label[v] = low
    return np.array(label, np.int64)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): the smallest node of its strongly connected component."""

    def run(t: pa.Table) -> pa.Table:
        names, s, o = coded(*_columns(t, "s", "o"))
        return pa.table({"node": names, "scc": names[_strong(len(names), s, o)]})

    return _together(deal(edges), "part").applyInArrow(run, "node long, scc long")


def _spread(at: np.ndarray, to: np.ndarray, roots: np.ndarray, seen: np.ndarray, fresh: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bits): what up to 64 distinct roots reach within depth, themselves included; bit k tells of root k. seen and fresh are zeros for each node, and left so."""
    front, visit = roots, np.uint64(1) << np.arange(len(roots), dtype=np.uint64)
    seen[front] = visit
    touched, d = [front], 0
    while len(front) and (depth is None or d < depth):
        d += 1
        entry, size = _rows(at, front)
        v = to[entry]
        np.bitwise_or.at(fresh, v, np.repeat(visit, size))
        near = np.unique(v)
        new = fresh[near] & ~seen[near]
        fresh[near] = 0
        front, visit = near[new != 0], new[new != 0]
        touched.append(front[seen[front] == 0])
        seen[front] |= visit
    nodes = np.concatenate(touched)
    bits = seen[nodes]
    seen[nodes] = 0
    return nodes, bits


def _table(bits: np.ndarray) -> np.ndarray:
    """64 columns of 0 and 1 for each of the bits."""
    return np.unpackbits(np.ascontiguousarray(bits, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _adjacent(n: int, s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(s, kind="stable")
    return np.searchsorted(s[by], np.arange(n + 1)), o[by]


def _reached(n: int, s: np.ndarray, o: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """For each of n nodes, how many of the distinct roots other than itself reach it.

    Strong components are one node. All that is below the largest of them is
    reached by all roots above it; those are followed only outside of what is
    below it, and only the other roots everywhere. No pair of root and node is
    listed: 64 roots go at a time.
    """
    label = _strong(n, s, o)
    heads, code, size = np.unique(label, return_inverse=True, return_counts=True)
    k = len(heads)
    pair = np.unique(code[s] * k + code[o])
    x, y = pair // k, pair % k
    x, y = x[x != y], y[x != y]
    weight = np.bincount(code[roots], minlength=k)
    starts = np.flatnonzero(weight)
    count, seen, fresh = np.zeros(k, np.int64), np.zeros(k, np.uint64), np.zeros(k, np.uint64)
    top = np.array([int(np.argmax(size))])
    low, high = np.zeros(k, bool), np.zeros(k, bool)
    low[_spread(*_adjacent(k, x, y), top, seen, fresh)[0]] = True
    high[_spread(*_adjacent(k, y, x), top, seen, fresh)[0]] = True
    count[low] += weight[high].sum()
    for those, kept in ((starts[high[starts] & ~low[starts]], ~low[y]), (starts[~high[starts]], np.ones(len(y), bool))):
        at, to = _adjacent(k, x[kept], y[kept])
        for b in range(0, len(those), 64):
            some = those[b : b + 64]
            nodes, bits = _spread(at, to, some, seen, fresh)
            count[nodes] += _table(bits)[:, : len(some)] @ weight[some]
    out = count[code]
    out[roots] -= 1
    return out


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n): how many of the roots (root) other than the node itself get to it, where any does."""
    e = deal(edges)
    r = members(e).join(roots.select(F.col("root").alias("node")).distinct(), "node").select("node", F.col("part").alias("of"))

    def run(t: pa.Table, asked: pa.Table) -> pa.Table:
        names, s, o = coded(*_columns(t, "s", "o"))
        n = _reached(len(names), s, o, np.searchsorted(names, asked.column("node").to_numpy()))
        return pa.table({"node": names[n > 0], "n": n[n > 0]})

    return _together(e, "part").cogroup(_together(r, "of")).applyInArrow(run, "node long, n long")


def scopes(edges: DataFrame, roots: DataFrame, about: DataFrame, depth: int | None) -> DataFrame:
    """(root, nodes, groups): of the rows about (node, group), those that each root (root) reaches within depth, itself included, and their distinct groups.

    Roots that reach no such row are left out. Many roots of a part are dealt to several tasks, each with the part.
    """
    e = deal(edges)
    own = settle(members(e))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    r = roots.select(F.col("root").alias("node")).distinct()
    here = r.join(own, "node")
    turns = settle(here.groupBy("part").agg(F.least(F.ceil(F.count("*") / TASK_ROOTS), F.lit(cores)).cast("int").alias("turns")))
    dealt = e.join(F.broadcast(turns), "part").select("s", "o", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    rows = about.select("node", F.col("group").cast("string").alias("group")).join(own, "node").join(F.broadcast(turns), "part")
    rows = rows.select(F.col("part").alias("of"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("at"), "node", "group", F.lit(False).alias("asked"))
    asked = here.join(F.broadcast(turns), "part").select("part", F.pmod(F.xxhash64("node"), F.col("turns")).cast("int").alias("at"), "node", F.lit(None).cast("string"), F.lit(True))

    def run(t: pa.Table, more: pa.Table) -> pa.Table:
        names, s, o = coded(*_columns(t, "s", "o"))
        root = np.searchsorted(names, more.filter(more.column("asked")).column("node").to_numpy())
        rest = more.filter(pc.invert(more.column("asked")))
        group = rest.column("group").combine_chunks().dictionary_encode()
        known = len(group.dictionary)
        group = np.asarray(group.indices.fill_null(known))  # rows without a group: the last, which does not count
        first, row = _adjacent(len(names), np.searchsorted(names, rest.column("node").to_numpy()), group)
        at, to = _adjacent(len(names), s, o)
        seen, fresh = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)
        nodes, groups = [], []
        for b in range(0, len(root), 64):
            some = root[b : b + 64]
            reached, bits = _spread(at, to, some, seen, fresh, depth)
            entry, size = _rows(first, reached)
            each = np.repeat(bits, size)
            by = np.zeros(known + 1, np.uint64)
            np.bitwise_or.at(by, row[entry], each)
            nodes.append(_table(each).sum(0, dtype=np.int64)[: len(some)])
            groups.append(_table(by[:known]).sum(0, dtype=np.int64)[: len(some)])
        n, g = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (nodes, groups))
        return pa.table({"root": names[root[n > 0]], "nodes": n[n > 0], "groups": g[n > 0]})

    found = _together(dealt, "part", "turn").cogroup(_together(rows.unionAll(asked), "of", "at")).applyInArrow(run, "root long, nodes long, groups long")
    alone = r.join(own, "node", "left_anti").join(about, "node").groupBy(F.col("node").alias("root")).agg(F.count("*").alias("nodes"), F.count_distinct("group").alias("groups"))
    return found.unionAll(alone)


def louvain(g: Packed, resolution: float = 1.0, m: float | None = None) -> np.ndarray:
    """A community for each node, named by its smallest node's index: moves by modularity gain, then the same over the communities.

    m is the weight of all edges, of which g may be what hangs together: moves
    within a component depend on nothing else of the rest.
    """
    home = np.arange(len(g))
    at, to, weight, loops = g.at, g.to, g.weight, np.zeros(len(g))
    m2 = 2 * (float(weight.sum()) / 2 if m is None else m)
    while m2 > 0:
        n = len(at) - 1
        comm, moved = _moves(at, to, weight, np.bincount(np.repeat(np.arange(n), np.diff(at)), weight, n) + 2 * loops, resolution, m2)
        if not moved:
            break
        kept, comm = np.unique(comm, return_inverse=True)
        if len(kept) == n:
            break
        home = comm[home]
        x, y = np.repeat(comm, np.diff(at)), comm[to]
        inside = x == y
        loops = np.bincount(comm, loops, len(kept)) + np.bincount(x[inside], weight[inside], len(kept)) / 2
        pair, group = np.unique(x[~inside] * len(kept) + y[~inside], return_inverse=True)
        weight = np.bincount(group, weight[~inside], len(pair))
        at, to = np.searchsorted(pair // len(kept), np.arange(len(kept) + 1)), (pair % len(kept)).astype(np.int32)
    low = np.full(len(g) + 1, len(g))
    np.minimum.at(low, home, np.arange(len(g)))
    return low[home]


def _moves(at: np.ndarray, to: np.ndarray, weight: np.ndarray, size: np.ndarray, resolution: float, m2: float) -> tuple[np.ndarray, bool]:
    """(community of each node, whether any moved): node after node goes where modularity gains most, the smallest of equals, until none moves.

    A node is looked at again only if a community next to it, or its own, has changed since.
    """
    n = len(at) - 1
    at, to, weight, size = at.tolist(), memoryview(np.ascontiguousarray(to, np.int32)), memoryview(np.ascontiguousarray(weight, float)), size.tolist()
    comm, total, changed, looked = list(range(n)), list(size), [0] * n, [-1] * n
    clock, any_moved, again = 0, False, True
    while again:
        again = False
        for i in range(n):
            b, e = at[i], at[i + 1]
            if b == e:
                continue
            near = [comm[j] for j in to[b:e]]
            own, last = comm[i], looked[i]
            if changed[own] <= last and all([changed[c] <= last for c in near]):
                continue
            links: dict[int, float] = {}
            for c, w in zip(near, weight[b:e]):  # noqa: B905
                links[c] = links.get(c, 0.0) + w
            mine = size[i]
            left = total[own] - mine
            part = resolution * mine
            stay = links.get(own, 0.0) - part * left / m2
            best, to_c = stay + 1e-12, own
            for c, x in links.items():
                if c != own:
                    pull = x - part * total[c] / m2
                    if pull > best or (pull == best and to_c != own and c < to_c):
                        best, to_c = pull, c
            clock += 1
            if to_c != own:
                total[own], total[to_c], comm[i] = left, total[to_c] + mine, to_c
                changed[own] = changed[to_c] = clock
                again = any_moved = True
            looked[i] = clock
    return np.array(comm, np.int64), any_moved


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, c): modularity communities, each named by its smallest node."""
    e = deal(edges)
    m = float(e.agg(F.sum("w")).first()[0] or 0)

    def run(t: pa.Table) -> pa.Table:
        g = _graph(t)
        return pa.table({"node": g.names, "c": g.names[louvain(g, resolution, m)]})

    return _together(e, "part").applyInArrow(run, "node long, c long")


# ------------------------------------------------------------- on top of them

# Shares of the hub score, and of the largest betweenness that makes a cut node a chokepoint.
HUB = {"betweenness": 0.6, "degree": 0.4}
CHOKE = 0.25
# How review scans the resolution, and when a community is oversized.
RESOLUTIONS = [0.5, 0.75, 1.0, 1.5, 2.0]
OVERSIZED, ROUNDS, GAIN = 0.25, 3, 1e-9


def hubs(edges: DataFrame, nodes: int, between: DataFrame | None = None) -> DataFrame:
    """(node, degree, betweenness, score) of a graph of so many nodes; score blends betweenness and the share of neighbours."""
    b = between if between is not None else betweenness(edges, nodes=nodes)
    d = degrees(edges).select("node", "degree")
    score = HUB["betweenness"] * F.col("betweenness") + HUB["degree"] * F.col("degree") / max(1, nodes - 1)
    return d.join(b.withColumnRenamed("score", "betweenness"), "node").select("node", "degree", "betweenness", F.round(score, 6).alias("score"))


def chokepoints(cut: DataFrame, hub: DataFrame) -> DataFrame:
    """(node, betweenness, score): articulation points with a quarter or more of the largest betweenness."""
    top = hub.agg(F.max("betweenness").alias("top"))
    points = cut.where("kind = 'articulation'").select(F.col("a").alias("node"))
    return hub.join(points, "node").join(F.broadcast(top)).where(f"top > 0 and betweenness >= {CHOKE} * top").select("node", "betweenness", "score")


def connected_parts(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(node, c, part): communities (node, c) cut into what is connected within them; part is its smallest node."""
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    inside = edges.where("s <> o").join(p("s"), "s").join(p("o"), "o").where("c_s = c_o").select("s", "o", "w")
    return partition.join(components(inside), "node", "left").select("node", "c", F.coalesce("component", "node").alias("part"))


def sweep(edges: DataFrame, resolutions: list[float] | None = None) -> DataFrame:
    """(resolution, communities, modularity): the partitions of several resolutions, measured at resolution 1; a task has a part and a resolution."""
    e = deal(edges)
    tried = [float(r) for r in resolutions or RESOLUTIONS]
    m = float(e.agg(F.sum("w")).first()[0] or 0)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        g = _graph(t)
        c = louvain(g, tried[key[1].as_py()], m)
        return pa.table({"k": pa.array([key[1].as_py()], pa.int32()), "communities": [len(np.unique(c))], "q": [_modularity(g, c, m)]})

    each = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(tried) - 1))))
    found = _together(each, "part", "k").applyInArrow(run, "k int, communities long, q double").groupBy("k").agg(F.sum("communities").alias("communities"), F.sum("q").alias("q"))
    rows = edges.sparkSession.createDataFrame(list(enumerate(tried)), "k int, resolution double")
    return rows.join(found, "k", "left").select("resolution", F.coalesce("communities", F.lit(0)).alias("communities"), F.round(F.coalesce("q", F.lit(0.0)), 6).alias("modularity"))


def _modularity(g: Packed, c: np.ndarray, m: float | None = None) -> float:
    """What the communities of g add to the modularity of a graph whose edges weigh m, by default g's."""
    m2 = float(g.weight.sum()) if m is None else 2 * m
    if not m2:
        return 0.0
    inside = g.weight[c[g.own] == c[g.to]].sum() / m2
    return float(inside - ((np.bincount(c[g.own], g.weight) / m2) ** 2).sum())


def _strength(edges: DataFrame, partition: DataFrame, m: float) -> float:
    """Modularity of partition (node, c), which has all ends of edges."""
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    e = edges.join(p("s"), "s").join(p("o"), "o")
    ends = e.select(F.col("c_s").alias("c"), "w", F.when(F.expr("c_s = c_o"), F.col("w")).otherwise(0).alias("i")).unionAll(e.select("c_o", "w", F.lit(0)))
    by = ends.groupBy("c").agg(F.sum("w").alias("tot"), F.sum("i").alias("i"))
    return float(by.agg(F.sum(F.col("i") / m - (F.col("tot") / (2.0 * m)) ** 2)).first()[0] or 0.0)


def split_oversized(edges: DataFrame, partition: DataFrame, share: float = OVERSIZED, factor: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """(node, c): communities of more than a share of all nodes are looked at again by themselves, at `factor` times the resolution, and cut if modularity gains."""
    e = deal(edges)
    m = float(e.agg(F.sum("w")).first()[0] or 0)
    known = partition.where(F.col("node").isNotNull()).groupBy("node").agg(F.max(F.col("c").cast("string")).alias("c"))
    now = settle(members(e).select("node").join(known, "node", "left").select("node", F.coalesce("c", F.col("node").cast("string")).alias("c")))
    n = now.count()
    for k in range(rounds):
        moved = False
        big = sorted(r.c for r in now.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > share * n).collect())  # fewer than 1 / share
        for b in big:
            own = now.where(F.col("c") == b).select("node")
            inside = e.join(own.withColumnRenamed("node", "s"), "s", "left_semi").join(own.withColumnRenamed("node", "o"), "o", "left_semi")
            # all of one piece or not, as long as it is the same edges they are dealt already
            inside = inside if own.count() == n else inside.drop("part")
            cut = communities(inside, factor ** (k + 1)).select("node", F.concat(F.lit(f"{k} {b} "), F.col("c")).alias("to"))
            new = settle(now.join(cut, "node", "left").select("node", F.coalesce("to", "c").alias("c")))
            parts = new.join(own, "node", "left_semi").select("c").distinct().limit(2).count()
            if parts > 1 and _strength(e, new, m) > _strength(e, now, m) + GAIN:
                now, moved = new, True
        if not moved:
            break
    low = now.groupBy("c").agg(F.min("node").alias("low"))
    return now.join(low, "c").select("node", F.col("low").alias("c"))


def labels(partition: DataFrame, tokens: DataFrame, most: int = 3) -> DataFrame:
    """(c, label): each community's most frequent tokens (node, token), ties by token."""
    n = partition.join(tokens, "node").groupBy("c", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c").orderBy(F.desc("n"), "token")
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ").alias("label"))


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, gained, lost): how many companions of its community (node, c) a node has gained and lost, among nodes in both.

    Companions are counted by pairs of old and new communities, never listed.
    """
    both = before.select("node", F.col("c").alias("b")).join(after.select("node", F.col("c").alias("a")), "node")
    cell = both.groupBy("b", "a").agg(F.count("*").alias("same"))
    old, new = both.groupBy("b").agg(F.count("*").alias("nb")), both.groupBy("a").agg(F.count("*").alias("na"))
    out = both.join(cell, ["b", "a"]).join(old, "b").join(new, "a")
    return out.select("node", (F.col("na") - F.col("same")).alias("gained"), (F.col("nb") - F.col("same")).alias("lost")).where("gained > 0 or lost > 0")

"""Graph kernels on what hangs together: the driver gathers no graph, and parts by themselves give the results of the whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrame

from evigraph.operators import graph as G
from evigraph.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session("tests", cores=4)


@pytest.fixture(autouse=True)
def nothing_gathered(monkeypatch):
    """Every component of four edges is a part by itself, and no table of edges comes to the driver as pandas."""

    def refuse(self):
        raise AssertionError("a graph on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(G, "PART_EDGES", 4, raising=False)


# two rings of cliques, a directed cycle with a tail, a star, and single edges
RINGS = [(b + c * 4 + i, b + c * 4 + j) for b in (0, 100) for c in range(3) for i in range(4) for j in range(i)] + [(b + c * 4, b + (c + 1) % 3 * 4 + 1) for b in (0, 100) for c in range(3)]
PAIRS = RINGS + [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204)] + [(300, 300 + i) for i in range(1, 6)] + [(400, 401), (500, 501), (501, 500)]


def edges(spark):
    return spark.createDataFrame([(a, b, 1.0) for a, b in PAIRS], "s long, o long, w double")


def whole():
    a = np.array(PAIRS, np.int64)
    return G.packed(a[:, 0], a[:, 1], np.ones(len(a)))


def test_betweenness_by_parts(spark):
    g = whole()
    total = sum(G._dependencies(g, i) for i in range(len(g))) / ((len(g) - 1) * (len(g) - 2))
    got = {r.node: r.score for r in G.betweenness(edges(spark)).collect()}
    assert got == pytest.approx(dict(zip(g.names.tolist(), total.tolist(), strict=True)), abs=1e-6)


def test_betweenness_from_evenly_spaced_sources(spark):
    g = whole()
    step = len(g) // 7
    some = range(0, len(g), step)
    total = sum(G._dependencies(g, i) for i in some) * len(g) / len(some) / ((len(g) - 1) * (len(g) - 2))
    got = {r.node: r.score for r in G.betweenness(edges(spark), sources=7, exact=10).collect()}
    assert got == pytest.approx(dict(zip(g.names.tolist(), total.tolist(), strict=True)), abs=1e-6)


def test_cuts_by_parts(spark):
    g = whole()
    points, bridges = (g.names[x] for x in G.cut_sets(g))
    rows = [tuple(r) for r in G.cuts(edges(spark)).collect()]
    assert {a for k, a, b in rows if k == "articulation" and b is None} == set(points.tolist())
    assert sorted((a, b) for k, a, b in rows if k == "bridge") == sorted(map(tuple, bridges.tolist()))
    assert len(rows) == len(points) + len(bridges)


def test_strong_components_by_parts(spark):
    got = {r.node: r.scc for r in G.strong_components(edges(spark)).collect()}
    assert got == {**{n: n for p in PAIRS for n in p}, **dict.fromkeys((200, 201, 202), 200), 500: 500, 501: 500, **cycles()}


def cycles():
    """Strong components of the rings of cliques, by reachability."""
    nodes = {n for p in RINGS for n in p}
    reach = {(n, n) for n in nodes} | set(RINGS)
    while (more := reach | {(a, d) for a, b in reach for c, d in RINGS if b == c}) != reach:
        reach = more
    return {n: min(m for m in nodes if (n, m) in reach and (m, n) in reach) for n in nodes}


def test_communities_by_parts(spark):
    g = whole()
    got = {r.node: r.c for r in G.communities(edges(spark)).collect()}
    assert got == dict(zip(g.names.tolist(), g.names[G.louvain(g)].tolist(), strict=True))


def test_oversized_by_parts(spark):
    """Two large communities at once are both looked at, each against what the other has become."""
    halves = spark.createDataFrame([(n, "a" if n < 100 else "b" if n < 200 else f"c{n}") for p in PAIRS for n in p], "node long, c string").distinct()
    got = {r.node: r.c for r in G.split_oversized(edges(spark), halves).collect()}
    assert got == {n: (n // 100 * 100 + n % 100 // 4 * 4 if n < 200 else n) for p in PAIRS for n in p}


def test_hubs_by_parts(spark):
    g = whole()
    e = G.deal(edges(spark))
    got = {r.node: (r.degree, r.score) for r in G.hubs(e, len(g)).collect()}
    between = {r.node: r.score for r in G.betweenness(e).collect()}
    degree = dict(zip(g.names.tolist(), np.diff(g.at).tolist(), strict=True))
    assert got == {n: (k, pytest.approx(0.6 * between[n] + 0.4 * k / (len(g) - 1), abs=1e-6)) for n, k in degree.items()}


def test_chokepoints_by_parts(spark):
    g = whole()
    e = G.deal(edges(spark))
    hub = G.hubs(e, len(g))
    between = {r.node: r.betweenness for r in hub.collect()}
    points = set(g.names[G.cut_sets(g)[0]].tolist())
    want = {n for n in points if between[n] >= G.CHOKE * max(between.values())}
    assert want and {r.node for r in G.chokepoints(G.cuts(e), hub).collect()} == want


def test_review_questions_without_a_graph_on_the_driver(spark):
    from __spark_entry__ import queries

    rows = queries()["review_questions"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 20 and {"bridge", "untested_hotspot"} <= {r.category for r in rows}


def test_sweep_by_parts(spark):
    g = whole()
    got = {r.resolution: (r.communities, r.modularity) for r in G.sweep(edges(spark), [0.5, 1.0, 2.0]).collect()}
    for r in (0.5, 1.0, 2.0):
        c = G.louvain(g, r)
        assert got[r] == (len(np.unique(c)), pytest.approx(G._modularity(g, c), abs=1e-6))


def test_sweep_without_edges(spark):
    none = spark.createDataFrame([], "s long, o long, w double")
    assert sorted(map(tuple, G.sweep(none, [1.0, 2.0]).collect())) == [(1.0, 0, 0.0), (2.0, 0, 0.0)]


def walked(roots, pairs, depth=None):
    """(root, node): what each root reaches within depth, itself included."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = set()
    for r in roots:
        seen, front, d = {r}, {r}, 0
        while front and (depth is None or d < depth):
            front, d = {y for x in front for y in near.get(x, ())} - seen, d + 1
            seen |= front
        out |= {(r, x) for x in seen}
    return out


def tangles(seed):
    """Directed graphs with a large strong component, what leads to it, from it and past it."""
    r = np.random.default_rng(seed)
    pairs = r.integers(0, 160, (220, 2))
    return sorted({(int(a), int(b)) for a, b in pairs if a != b})


def test_reach_counts_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "bfs", None)
    for seed in (1, 2):
        pairs = tangles(seed)
        for roots in ({a for a, _ in pairs} - {b for _, b in pairs}, {x for p in pairs for x in p if x % 3}):
            want = {}
            for r, n in walked(roots, pairs):
                if r != n:
                    want[n] = want.get(n, 0) + 1
            df = spark.createDataFrame([(x,) for x in [*roots, *roots, 999]], "root long")
            e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "s long, o long, w long")
            assert {x.node: x.n for x in G.reached(e, df).collect()} == want


def test_risk_scores_list_no_pairs(spark, monkeypatch):
    from __spark_entry__ import queries
    from evigraph.operators import code

    monkeypatch.setattr(code, "bfs", None)
    assert queries()["risk_scores"](spark, "/root/testdata/sf0.001").count() == 200


def test_flow_catalogue_lists_no_pairs(spark, monkeypatch):
    from evigraph.operators import code

    monkeypatch.setattr(code, "bfs", None)
    monkeypatch.setattr(G, "TASK_ROOTS", 5, raising=False)
    for seed in (1, 2):
        pairs = tangles(seed)
        path = {n: None if n % 11 == 0 else f"p{n % 7}" for p in pairs for n in p if n % 13} | {999: "alone"}
        for roots in ({a for a, _ in pairs} - {b for _, b in pairs} | {999}, {n for p in pairs for n in p}):
            want = {}
            for r, n in walked(roots, pairs, 4):
                if n in path:
                    want.setdefault(r, []).append(path[n])
            want = {r: (len(x), len({y for y in x if y})) for r, x in want.items()}
            e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "s long, o long, w long")
            n = spark.createDataFrame(list(path.items()), "id long, path string")
            got = code.flow_catalogue(e, spark.createDataFrame([(x,) for x in [*roots, *roots]], "root long"), n, 4)
            assert {x.root: (x.steps, x.paths) for x in got.collect()} == want

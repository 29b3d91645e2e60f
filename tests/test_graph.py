"""Graph operators on planted graphs, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from evigraph.operators import graph as G
from evigraph.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session("tests", cores=4)


def edges(spark, pairs, w=None):
    return spark.createDataFrame([(a, b, float(w[i] if w else 1)) for i, (a, b) in enumerate(pairs)] or [], "s long, o long, w double")


def groups(nodes, pairs):
    """Sets of connected nodes."""
    out = {n: {n} for n in nodes}
    for a, b in pairs:
        if out[a] is not out[b]:
            out[a] |= out[b]
            for x in out[b]:
                out[x] = out[a]
    return {frozenset(v) for v in out.values()}


def graphs(n=60, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        k = r.randint(2, 14)
        yield list({(r.randrange(k), r.randrange(k)) for _ in range(r.randint(1, 2 * k))})


def packed(pairs):
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([p[1] for p in pairs], np.int64)
    return G.packed(a, b, np.ones(len(pairs)))


def test_cut_sets_against_removal():
    for pairs in graphs(300):
        g = packed(pairs)
        plain = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
        nodes = {x for p in plain for x in p}
        whole = len(groups(nodes, plain))
        bridges = {p for p in plain if len(groups(nodes, plain - {p})) > whole}
        points = {v for v in nodes if len(groups(nodes - {v}, {p for p in plain if v not in p})) > whole - (not any(v in p for p in plain))}
        got_points, got_bridges = G.cut_sets(g)
        assert {tuple(g.names[list(b)].tolist()) for b in got_bridges} == bridges
        assert set(g.names[got_points].tolist()) == points


def test_betweenness_against_all_paths(spark):
    def brute(pairs):
        near = {}
        for a, b in pairs:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        score = dict.fromkeys(near, 0.0)
        for s, t in itertools.permutations(near, 2):
            front, paths = [[s]], []
            while front and not paths:
                paths = [p for p in front if p[-1] == t]
                front = [[*p, x] for p in front for x in near[p[-1]] if x not in p]
            for p in paths:
                for v in p[1:-1]:
                    score[v] += 1 / len(paths)
        n = len(near)
        return {v: round(x / max(1, (n - 1) * (n - 2)), 6) for v, x in score.items()}

    for pairs in graphs(5, seed=3):
        got = {r.node: r.score for r in G.betweenness(edges(spark, pairs)).collect()}
        assert got == pytest.approx(brute(pairs), abs=2e-6)


def test_strong_components_and_components(spark):
    for pairs in graphs(6, seed=5):
        plain = [p for p in pairs if p[0] != p[1]]
        nodes = {x for p in plain for x in p}
        reach = {(n, n) for n in nodes} | set(plain)
        while (more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) != reach:
            reach = more
        want = {n: min(m for m in nodes if (n, m) in reach and (m, n) in reach) for n in nodes}
        assert {r.node: r.scc for r in G.strong_components(edges(spark, pairs)).collect()} == want
        comp = {r.node: r.component for r in G.components(edges(spark, plain)).collect()}
        assert comp == {n: min(c) for c in groups(nodes, plain) for n in c}


def test_components_refuse_to_answer_unsettled(spark):
    path = edges(spark, [(i, i + 1) for i in range(300)])
    assert {r.component for r in G.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        G.components(path, rounds=2)


def ring_of_cliques(k=8, size=6):
    pairs = [(c * size + i, c * size + j) for c in range(k) for i in range(size) for j in range(i)]
    return pairs + [(c * size, ((c + 1) % k) * size + 1) for c in range(k)]


def test_planted_communities(spark):
    pairs = ring_of_cliques()
    got = {r.node: r.c for r in G.communities(edges(spark, pairs)).collect()}
    assert got == {n: n // 6 * 6 for n in range(48)}
    g = packed(pairs)
    assert G._modularity(g, np.arange(48) // 6) == pytest.approx(max(G._modularity(g, G.louvain(g, r)) for r in (0.75, 1.0, 1.5)))
    rows = {r.resolution: r.communities for r in G.sweep(edges(spark, pairs)).collect()}
    assert rows[1.0] == 8 and rows[0.5] <= rows[2.0]


def test_oversized_communities_are_split(spark):
    pairs = ring_of_cliques(4, 8)
    one = spark.createDataFrame([(n, "all") for n in range(32)], "node long, c string")
    got = {r.node: r.c for r in G.split_oversized(edges(spark, pairs), one).collect()}
    assert got == {n: n // 8 * 8 for n in range(32)}


def test_parts_hubs_and_chokepoints(spark):
    # two stars that share one leaf
    pairs = [(0, i) for i in range(1, 6)] + [(10, i) for i in range(11, 16)] + [(0, 20), (10, 20)]
    e = edges(spark, pairs)
    hub = G.hubs(e, 13)
    rows = {r.node: r for r in hub.collect()}
    assert rows[0].degree == 6 and rows[0].score == pytest.approx(0.6 * rows[0].betweenness + 0.4 * 6 / 12, abs=1e-6)
    assert {r.node for r in G.chokepoints(G.cuts(e), hub).collect()} == {0, 10, 20}
    p = spark.createDataFrame([(n, "a" if n in (1, 2, 0, 11, 12, 10) else "b") for n in {x for q in pairs for x in q} | {77}], "node long, c string")
    parts = {r.node: r.part for r in G.connected_parts(e, p).collect()}
    assert parts[1] == parts[2] == 0 and parts[11] == parts[12] == 10 and parts[3] == 3 and parts[77] == 77


def test_membership_changes(spark):
    r = random.Random(2)
    b, a = ({n: r.randrange(3) for n in r.sample(range(12), 10)} for _ in "ba")
    both = b.keys() & a.keys()
    mates = lambda m, n: {x for x in both if m[x] == m[n] and x != n}
    want = {n: (len(mates(a, n) - mates(b, n)), len(mates(b, n) - mates(a, n))) for n in both}
    df = lambda m: spark.createDataFrame(list(m.items()), "node long, c long")
    got = {r.node: (r.gained, r.lost) for r in G.membership_changes(df(b), df(a)).collect()}
    assert got == {n: x for n, x in want.items() if x != (0, 0)}


def test_a_graph_too_large_is_refused(spark):
    with pytest.raises(ValueError):
        G.gather(edges(spark, [(1, 2), (2, 3), (3, 4)]), most=2)

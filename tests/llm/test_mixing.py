import numpy as np
import pytest

from evigraph.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert M.targets([10, 1000, 0], [1, 2, 3]) == pytest.approx([30, 980, 0])
    assert M.targets([], []) == []


def test_permutations_and_draws():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, 9):
            got = M.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
    quotas = np.array([5, 0, 900, 40])
    whole = list(M.draws(quotas, 100, 3, 0, 10**9))
    counts = np.zeros((len(whole), 4), int)
    for shard, who, got, before in whole:
        assert (before == counts[:shard].sum(0)[who]).all() and (got > 0).all()
        counts[shard, who] = got
    assert counts.sum(0).tolist() == [5, 0, 900, 40] and (counts.sum(1)[:-1] == 100).all()
    # a task that walks to some shards finds what the walk to all finds
    parts = [x for lo in range(0, 12, 3) for x in M.draws(quotas, 100, 3, lo, lo + 3)]
    assert [(s, w.tolist(), g.tolist(), t.tolist()) for s, w, g, t in parts] == [(s, w.tolist(), g.tolist(), t.tolist()) for s, w, g, t in whole]
    assert list(M.draws(np.zeros(0, int), 100, 3, 0, 9)) == []


def rows():
    rng = np.random.default_rng(4)
    out = [(i, " ".join(f"s{i}w{j}" for j in range(int(rng.integers(0, 300)))), ["b", "a", None, "ü"][int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]) for i in range(300)]
    return out + [(1000, None, "a"), (1001, "", "empty"), (3, "x y", "a"), (3, "x y", "a")]


def test_mix(spark):
    df = spark.createDataFrame([(*r, "t") for r in rows()], "doc_id long, text string, source string, target string").repartition(3)
    mixed = M.mix(df, block=16, per_shard=64)
    got = mixed.taken().collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.taken
        s[1] += r.size
    for taken, size, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 16
    # the texts are what was taken, and only whole words of the documents
    texts = mixed.texts().collect()
    assert len(texts) == len({(t.shard, t.place) for t in texts})
    seen = {}
    for t in texts:
        for w in t.text.split():
            seen[w] = seen.get(w, 0) + 1
    total = sum(r.taken for r in got)
    assert sum(seen.values()) == total
    sizes = {r.doc_id: r.taken for r in got}
    for i in range(300):
        if i != 3:
            assert sum(n for w, n in seen.items() if w.startswith(f"s{i}w")) == sizes[i]
    again = M.mix(df.repartition(7), block=16, per_shard=64).taken().select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.size, r.taken) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).taken().collect() == []


def test_clashing_columns_null_ids_and_repeats(spark):
    rows = [(None, "a b c", "x")] * 50 + [(7, "d e", "x")] * 3 + [(None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, rank int, begin int")
    got = M.mix(df, block=4, per_shard=8).taken().collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.size for r in got) == 156 and {r.source_size for r in got if r.source == "x"} == {156}
    assert M.mix(df.limit(0)).taken().collect() == []

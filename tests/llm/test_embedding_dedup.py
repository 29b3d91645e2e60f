import numpy as np
import pytest

from evigraph.llm.embedding_dedup import near_duplicates


def brute(ids, vectors, threshold=0.95):
    ok = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(ids))}
    for i in ok:
        for j in ok:
            a, b = np.array(vectors[i], float), np.array(vectors[j], float)
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(ids[j] for j in seen)
        out.append((ids[i], len(links[i]), low, ids[i] == low))
    return sorted(out)


@pytest.mark.parametrize("block", [1500, 7])
def test_as_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    v = [x for x in base]
    for i in range(60):
        v.append(base[i % 9] * rng.uniform(0.5, 2) + rng.standard_normal(64) * rng.uniform(0.02, 0.36))
    v += [base[3], base[3], base[100], -base[3]]
    v = [x.astype(np.float32).tolist() for x in v]
    v += [None, [], [0.0] * 64, [float("nan"), *[1.0] * 63], [None, *[1.0] * 63], [float("inf"), *[1.0] * 63], [1.0, 2.0], [1.0, 2.0], [2.0, 4.01]]
    ids = rng.permutation(len(v)).tolist()
    rows = list(zip(ids, v, range(len(v)), strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = near_duplicates(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute(ids, v)


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0])], schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (7, 0, 7, True), (7, 1, 7, True)]

import random

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import common as C
from evigraph.llm import minhash_dedup as M
from evigraph.llm.minhash_dedup import near_duplicates


def brute(rows, k=5, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = {i: [j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))}
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(sets[i]), c, rows[i][0] == c))
    return sorted(out)


def made(seed, groups, size, rate):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "of", "É", "é", *[f"w{i}" for i in range(500)]])
    boiler = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 40, 200, 400]))]
        for _ in range(r.randint(1, size)):
            w = [word() if r.random() < rate * r.random() else x for x in base]
            if r.random() < 0.4:
                w += boiler
            texts.append(" ".join(w if r.random() < 0.8 else [x.upper() if x.isascii() else x for x in w]))
    texts += [texts[5]] * 20 + ["", " \n", None, "One", "one", "one two", "ONE  two"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_as_brute_force(spark):
    rows = made(3, 60, 9, 0.08)
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "doc_id long, text string, n long, print string").repartition(3)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == brute(rows)


def test_large_groups_of_near_copies(spark):
    rows = made(4, 3, 260, 0.06)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == brute(rows)


def test_empty_and_odd_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    t, u = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, u), (3, u)], schema)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 26, 0, True), (3, 26, 3, True), (5, 26, 3, False), (5, 26, 5, True)]


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.9])
def test_recall_of_all_levels(similarity):
    trees, again = M.branchings(similarity, 0.9999)
    assert all(M.recall_at(similarity, trees, again, level) >= 0.9999 for level in range(2, M.LEVELS + 2))


def test_pairs_that_meet_at_the_last_level_only():
    """The kernels on the sketches of 1,000 pairs at 0.75: who shares no node of the last level."""
    r = np.random.default_rng(6)
    left = r.integers(0, 1 << 32, (1000, M.T), dtype=np.uint32)
    right = np.where(r.random(left.shape) < 0.75, left, r.integers(0, 1 << 32, left.shape, dtype=np.uint32))
    trees, again = M.branchings(0.75, 0.9999)
    met = set()
    for lo in range(0, 1000, 100):
        tokens = [x.tobytes() for x in np.concatenate([left[lo : lo + 100], right[lo : lo + 100]])]
        ids = pa.array(range(200))
        for level in M._roots(trees)([pa.RecordBatch.from_arrays([ids, ids, pa.array(tokens, pa.binary())], ["id", "n", "sketch"])]):
            for depth in range(1, M.LEVELS):
                sketch = pa.array([tokens[i] for i in level.column(1).to_pylist()], pa.binary())
                full = pa.RecordBatch.from_arrays([*level.columns[:3], level.column(2), sketch], ["node", "id", "n", "comp", "sketch"])
                level = pa.concat_batches(list(M._deeper(again if depth == 1 else 1)([full])))
            node, who = level.column(0).to_numpy(), level.column(1).to_numpy()
            a, b = ({*zip(node[x].tolist(), (who[x] % 100).tolist())} for x in (who < 100, who >= 100))
            met |= {lo + i for _, i in a & b}
    assert len(met) >= 999


def test_words_that_a_polynomial_confuses(spark):
    """A Thue-Morse word and its complement are equal under every polynomial hash modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r for r in M.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].kept and got[2].component_id == 2


def tasks_of(spark, run):
    """The tasks of all jobs that run starts."""
    group = f"tasks-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_tasks_where_no_partitions_are_merged(spark):
    """Where a shuffle keeps its partitions, the run costs what its shuffles are: rows of one large group of near copies."""
    df = spark.createDataFrame(made(4, 3, 100, 0.06), "doc_id long, text string").repartition(3)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        took = tasks_of(spark, lambda: near_duplicates(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < took <= 40 * 35


@pytest.mark.parametrize("together", [0, 30, 10_000])
def test_components_in_one_task_or_in_rounds(spark, together):
    r = random.Random(8)
    edges = [(r.randint(-400, 400), r.randint(-400, 400)) for _ in range(350)] + [(7, 7), (900, 901), (900, 901)]
    got = [tuple(x) for x in C.components(spark.createDataFrame(edges, "a long, b long").repartition(5), together=together).collect()]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert sorted(got) == sorted(label.items())
    none = spark.createDataFrame([(3, 3)], "a long, b long")
    assert C.components(none, together=together).collect() == []

import hashlib
import random

import pytest

from evigraph.llm.substring_dedup import remove_repeats


def brute(rows, k=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "the", "ñandú", "x y", *[f"w{i}" for i in range(300)]])
    shared = [[word() for _ in range(r.randint(13, 80))] for _ in range(5)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, " ".join(["la"] * 40)), (905, "\n".join(["la"] * 30))]
    for d in range(120):
        w = [word() for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i:i] = r.choice(shared)
        rows.append((d, r.choice([" ", "  ", "\n", " \t"]).join(w)))
    rows += [(500 + i, rows[20][1]) for i in range(40)] + [(30, rows[40][1]), (30, rows[36][1])]
    return rows


@pytest.mark.parametrize("how", [{}, {"hot_share": 1e-3, "hot_least": 4}])
def test_as_brute_force(spark, how):
    rows = made()
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False, **how)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty_null_ids_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == []
    t = " ".join(str(i) for i in range(20))
    df = spark.createDataFrame([(None, t, 1, "z"), (4, t, 2, "y")], "doc_id long, text string, n long, kept string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in remove_repeats(df).collect()}
    assert got == {4: (0, t), None: (20, "")}

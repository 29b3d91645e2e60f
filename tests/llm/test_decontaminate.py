import random

import numpy as np

from evigraph.llm import decontaminate as D


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 90))] for _ in "ab")
        assert D.lcs(np.array(a, int), np.array(b, int))[0] == plain_lcs(a, b)


def made():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice([2, 3, 4, 5])))
    common = ["the", "of", "and", "in"]
    prose = lambda n: [r.choice(common) if r.random() < 0.3 else word() for _ in range(n)]
    items = [(i, prose(r.randint(15, 59))) for i in range(30)]
    docs, copies, para = [], set(), set()
    for d in range(200):
        w = prose(r.choice([0, 5, 80, 400]))
        if d % 4 == 0:
            i, t = r.choice(items)
            if d % 8:
                t = [x if r.random() > 0.15 else word() for x in t]
                para.add((d, i))
            else:
                copies.add((d, i))
                t = [x.upper() + r.choice(["", ",", "."]) for x in t]
            k = r.randint(0, len(w))
            w[k:k] = t
        docs.append((d, " ".join(w)))
    return docs, [(i, " ".join(t)) for i, t in items], copies, para


def brute(docs, items, copy=0.75):
    """Pairs by the subsequence alone: all stretches of all documents against all items."""
    fold = lambda t: bytes(D._FOLD[b] for b in t.encode()).split()
    out = set()
    for d, t in docs:
        w = fold(t)
        for i, x in items:
            x = fold(x)
            span = len(x) + len(x) // 2
            if len(set(x) & set(w)) >= 0.5 * len(set(x)) and any(plain_lcs(x, w[k : k + span]) >= copy * len(x) for k in range(0, max(1, len(w) - len(x) + 1), 3)):
                out.add((d, i))
    return out


def test_recall_and_precision(spark):
    docs, items, copies, para = made()
    df = spark.createDataFrame([(*d, 1.0) for d in docs] + [(900, None, 1.0), (None, items[0][1], 1.0), (0, docs[0][1], 1.0)], "doc_id long, text string, lcs double").repartition(3)
    bench = spark.createDataFrame([(*i, 2) for i in items] + [(77, None, 2), (78, "", 2), items[3] + (5,)], "item_id long, text string, doc_id int")
    rows = D.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) == len(got)
    assert copies <= got <= copies | para
    want = brute(docs, items)
    assert len(got & want) >= 0.9 * len(want) and len(got & para) >= 0.8 * len(para)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == []


def test_items_longer_than_passages(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate([40, 70, 100, 150, 150, 150, 500, 500, 500, 2000])]
    docs, want = [], set()
    for d in range(120):
        w = prose(r.choice([0, 30, 400]))
        if d % 2:
            i, t = items[d // 2 % len(items)]
            # half of them with a tenth of the words replaced
            t = [word() if d % 4 == 1 and r.random() < 0.1 else x for x in t]
            k = r.randint(0, len(w))
            w[k:k] = t
            want.add((d, i))
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    # one piece alone is not the item
    part = spark.createDataFrame([(1, " ".join(prose(50) + items[6][1][100:160] + prose(50)))], "doc_id long, text string")
    assert D.contaminated(part, bench).collect() == []


def test_repeated_items(spark):
    r = random.Random(5)
    prose = lambda n: ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    one, frame = prose(30), prose(28)
    # a third of the items is one text, a third one text but for a word, and one item is a single word
    texts = [one] * 10 + [[*frame, f"x{i}"] for i in range(10)] + [prose(30) for _ in range(9)] + [["lonelyword"]]
    docs = [(d, " ".join(prose(60) + (texts[d] if d < 30 else []) + prose(60))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contaminated(df, bench).collect()}
    near = lambda d: range(10) if d < 10 else range(10, 20) if d < 20 else [d]
    assert got == {(d, i) for d in range(30) for i in near(d)}
    # nothing but one text
    same = spark.createDataFrame([(i, " ".join(one)) for i in range(20)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated(df, same).collect()} == {(d, i) for d in range(10) for i in range(20)}


def test_no_term_is_lost():
    r = random.Random(3)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30)), None) for i in range(1000)]
    ix = D.index(items)
    assert all((ix.find(t) >= 0).all() for t in ix.tokens)


def test_a_benchmark_in_rounds(spark):
    docs, items, copies, _ = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once, rounds = ({(r.doc_id, r.item_id) for r in D.contaminated(df, bench, at_once=n).collect()} for n in (30, 11))
    assert copies <= once and copies <= rounds


def test_rows_without_an_id_leak_too(spark):
    docs, items, _, _ = made()
    df = spark.createDataFrame([(None, items[0][1]), (1, items[0][1]), (1, "nothing of it"), (2, None), (3, "")], "doc_id long, text string")
    got = D.leaking(df, spark.createDataFrame(items, "item_id long, text string"))
    bodies = {r.h for r in df.where("length(text) > 20").selectExpr("xxhash64(text) as h").collect()}
    assert {(r.doc, r.body) for r in got.collect()} == {(d, b) for d in (None, 1) for b in bodies}

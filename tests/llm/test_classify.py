import random
import zlib

import numpy as np
import pyarrow as pa

from evigraph.llm import classify, subword
from evigraph.llm import common as C


def made(n=400, seed=2):
    r = random.Random(seed)
    bits = {"en": ["th", "er", "ing", "wh", "ou", "ea", "the"], "de": ["sch", "ung", "ei", "ä", "tz", "der"], "fr": ["eau", "é", "tion", "que", "les"]}
    out = []
    for i in range(n):
        lang = r.choice(list(bits))
        toxic = r.random() < 0.4
        w = ["".join(r.choice(bits[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(1 + len(w) // 30):
                w.insert(r.randrange(len(w)), r.choice(["moron", "morons", "moronic", "idiot", "idiots"]))
        out.append((i, " ".join(w), lang, int(toxic)))
    return out


def test_sums_are_the_bag():
    bags = subword.Bags(1 << 12, (2, 3))
    rng = np.random.default_rng(1)
    table = rng.integers(-1000, 1000, (1 << 12, 2)).astype(np.int32)
    texts = ["", "a", " Été  d'été ", "x" * 50, "one two\nthree"]
    for (idx, share), (total, count) in zip(bags.bag(texts), [bags.sums(w, table) for t in texts for _, _, w in C.pieces(subword.lowered(pa.array([t], pa.large_string())))], strict=True):
        assert np.allclose(share @ table[idx].astype(float) * count[0] if len(idx) else 0, total[0], atol=1)


def test_languages(spark):
    rows = made()
    odd = [(1000, None, "en", 0), (1001, "", "de", 0), (1002, "123 !!", "fr", 0), (1003, "eau tion que les eau", None, 0), (1003, "eau tion que les eau", None, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, toxic int, score string").repartition(3)
    got = classify.languages_of(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "fr"] and by[1000].score == 0
    none = classify.languages_of(df.withColumn("lang", df.lang.substr(1, 0)).where("false")).collect()
    assert none == []


def test_toxicity(spark):
    rows = made(600, 3)
    df = spark.createDataFrame([(r[0], r[1], "s") for r in rows] + [(900, None, "s"), (901, "you m0ron, morron", "s"), (901, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify.toxicity_of(df, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, t) for i, _, _, t in rows if by[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert max(r.score for r in got if r.doc_id == 901) > 0.5
    nobody = classify.toxicity_of(df, labels.limit(0)).collect()
    assert {r.predicted for r in nobody} == {0}


def test_a_repeated_text_counts_once(spark):
    """One text repeated 3,000 times, whichever its hash, takes one place in the sample, and each label has its own."""
    rows = [(i, f"text number {i}", "en" if i % 100 else "xx") for i in range(3000)]
    least = min(spark.createDataFrame(rows, "id long, text string, lang string").selectExpr("text", "xxhash64(text) as h").collect(), key=lambda r: r.h).text
    df = spark.createDataFrame(rows + [(5000 + i, least, "en") for i in range(3000)] + [(None, None, "en"), (None, least, None)], "doc_id long, text string, lang string").repartition(4)
    h = df.selectExpr("doc_id as id", "xxhash64(text) as h", "lang as y", "text").where("text is not null")
    got = classify.sample(h.select("id", "h", "text"), h.select("id", "h", "y"), lambda labels: 100 // labels)
    texts = [r.text for r in got]
    assert len(set(texts)) == len(texts) and least in texts
    assert sum(r.y == "xx" for r in got) == 30 and sum(r.y == "en" for r in got) == 50


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a fine day", "q", "s", True)] * 2, "doc_id long, text string, lang_pred string, score string, accepted boolean")
    model = subword.fit(["a fine day", "you idiot"], [0, 1], subword.Bags(), dim=4)
    out = classify.less_toxic(df, model, 2.0)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()]
    assert classify.toxicity(df, model, *df.columns).columns == ["doc_id", "text", "lang_pred", "accepted", "score"]
    assert classify.identify(df, model, *df.columns).columns == ["doc_id", "text", "lang_pred", "score", "accepted"]

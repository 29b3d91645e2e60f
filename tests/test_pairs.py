"""Joins whose pairs are many: dealt to several tasks whatever a key holds, with the results of all pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evigraph.operators import ledger
from evigraph.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session("tests", cores=4)


def test_references_to_one_name_are_resolved_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "NAME_REFS", 10, raising=False)
    monkeypatch.setattr(ledger, "NAME_SYMBOLS", 7, raising=False)
    names = {i: "common" if i < 300 else "single" if i < 340 else f"n{i % 9}" if i < 380 else None for i in range(400)}
    symbols = [(i, "common") for i in range(40)] + [(50, "single"), (60, "n1"), (61, "n1"), (62, "n2"), (63, None), (64, "unused")]
    refs = spark.createDataFrame(list(names.items()), "ref long, name string")
    got = ledger.resolve_references(refs, spark.createDataFrame(symbols, "id long, name string"))
    k = {n: sum(x == n for _, x in symbols) for _, n in symbols}
    want = sorted((r, i, 0.9 if k[n] == 1 else 0.6) for r, n in names.items() if n for i, x in symbols if x == n)
    assert sorted(map(tuple, got.collect())) == want
    assert got.where("ref < 300").select(F.spark_partition_id()).distinct().count() > 1


def test_similar_pairs_are_multiplied_in_blocks(spark, monkeypatch):
    from evigraph.operators import search

    rows = [(f"{i}:{i % 3}", " ".join(f"w{(i * i + j * (1 + i % 4)) % 19}" for j in range(2 + i % 7))) for i in range(150)] + [("x:0", ""), ("x:1", None)]
    chunks = spark.createDataFrame(rows, "id string, text string")
    want = {(r.a, r.b): r.score for r in search._prefixed(search.hashed_vectors(chunks), 0.9).collect()}
    monkeypatch.setattr(search, "_prefixed", None)
    for block, strip in ((40, 8 * 256 * 5), (10**6, 1)):
        monkeypatch.setattr(search, "BLOCK_ROWS", block)
        monkeypatch.setattr(search, "STRIP", strip)
        got = [tuple(r) for r in search.similar_pairs(chunks).collect()]
        assert len(got) == len(want) > 50
        assert {(a, b): s for a, b, s in got} == pytest.approx(want, abs=2e-6)


def planted(n=160):
    """(subject, object) of few topics, with numbers, units, negations and opposites, and objects that differ by case alone."""
    say = ["open all day", "closed on sunday", "not open all day", "5 minutes long", "300 sec long", "6 kb large", "6 minutes long", "open and closed", "OPEN and closed", "safe", "unsafe for all", "Open all day ", "", "-0 or 0.0", "7"]
    return [(f"The {['gate', 'gate door', 'tower'][i % 3]} {['', 'v2'][i % 2]}".strip(), say[i // 6 % len(say)] + (f" {'abc'[i % 3]}" if i % 5 == 0 else "")) for i in range(n)]


def by_pairs(spark, rows):
    """score of each ordered pair of objects, compared one by one."""
    from evigraph.operators import evidence

    objects = sorted({o for _, o in rows})
    d = spark.createDataFrame([(o,) for o in objects], "a string")
    return {(r.a, r.b): r.s for r in d.crossJoin(d.withColumnRenamed("a", "b")).select("a", "b", evidence.compare(F.col("a"), F.col("b")).alias("s")).collect()}


def test_contradictions_of_a_subject_compare_kinds(spark, monkeypatch):
    from evigraph.operators import evidence

    rows = planted()
    score = by_pairs(spark, rows)
    monkeypatch.setattr(evidence, "compare", None)  # no pair of claims is compared
    claims = spark.createDataFrame([("is", s, o) for s, o in rows], "predicate string, subject string, object string")
    got = sorted((r.subject, r.a, r.b, r.score) for r in evidence.same_subject(claims).collect())
    said = sorted({(s.lower(), o) for s, o in rows})
    want = sorted((s, a, b, score[a, b]) for s, a in said for t, b in said if s == t and a < b and score[a, b] >= 0.5)
    assert got == want and {0.5, 0.7, 0.8} == {r[3] for r in got}


def test_paraphrases_compare_kinds(spark, monkeypatch):
    from evigraph.operators import evidence

    rows = planted()
    score = by_pairs(spark, rows)
    claims = spark.createDataFrame([("is", s, o) for s, o in rows], "predicate string, subject string, object string")
    said = {(r.subject, r.object): (set(r.topic), r.ids) for r in evidence.topics(claims).select(F.lower("subject").alias("subject"), "object", "topic", "ids").collect()}
    looked_at = []
    judge = evidence._at_odds
    monkeypatch.setattr(evidence, "_at_odds", lambda *a: looked_at.append(judge(*a)) or looked_at[-1])
    got = sorted(map(tuple, evidence.paraphrases(claims).select("a_subject", "a_object", "b_subject", "b_object", "score").collect()))
    want = set()
    for x, (topic, ids) in said.items():
        for y, (other, its) in said.items():
            if topic and topic <= other and ids == its and x[0] != y[0] and score[x[1], y[1]] >= 0.5:
                want.add((*min(x, y), *max(x, y), score[x[1], y[1]]))
    assert got == sorted(want) and got
    assert len(looked_at) == 1 and looked_at[0].where("x_kind = y_kind and score < 0.8").isEmpty()


def test_a_scan_reads_its_claims_once(spark):
    from evigraph.operators import ledger

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("is", s, o) for s, o in planted()]
    claims = spark.createDataFrame(rows, "predicate string, subject string, object string").mapInArrow(seen, "predicate string, subject string, object string")
    assert {r.route for r in ledger.scan(claims).collect()} == {"same_subject", "paraphrase"}
    assert read.value == len(rows)

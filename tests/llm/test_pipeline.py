import corpus_pipeline
from evigraph.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, docs, SF), f"{common.scratch(spark)}/{name}")
        assert out.columns == columns, name
        assert 0 < out.count() <= docs.count()
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r.taken <= 3 * r.size for r in last)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, last))


def test_near_duplicates_take_out_rows_not_ids(spark):
    t, u = ("one two three four five six seven eight nine ten " * 3, "alpha beta gamma delta epsilon zeta eta theta iota " * 3)
    rows = [(5, t, "a"), (5, u, "b"), (3, u, "c"), (None, u, "d"), (7, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert {r.score for r in got.collect()} == {"a", "c", "d", "e", "f"}

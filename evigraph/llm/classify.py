"""Language identification and toxicity scoring with the subword model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import subword

UNKNOWN = "und"
#: Distinct labelled texts that a model is fitted on at most, those of the smallest hashes; every fifth calibrates it.
#: Languages share LANGUAGE_ROWS evenly, but each has LANGUAGE_LEAST where there are so many.
LANGUAGE_ROWS = 2500
LANGUAGE_LEAST = 50
TOXIC_ROWS = 1500
CLEAN_ROWS = 4500
LEAST_TEXTS = 3  # a gram of fewer texts teaches the toxicity model nothing


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo `by`; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % by, F.lit(0))


def sample(docs: DataFrame, marks: DataFrame, quota: dict | Callable[[int], int]) -> list:
    """Rows (y, text) of docs (id, h, text): distinct texts of the smallest hashes, for each label as many as its quota.

    marks (id, h, y) says which rows have which label; it holds no texts. A
    text's copies count once, and each label is filled by itself, so neither a
    repeated text nor a rare label is lost. Ids and hashes are picked first, on
    narrow rows; only the texts picked leave their tasks. quota: by label, or of
    the number of labels for each of them.
    """
    spark = docs.sparkSession
    one = C.settle(marks.where("y is not null and h is not null").groupBy("y", "h").agg(F.min("id").alias("id")), f"{C.scratch(spark)}/marks")
    counts = one.groupBy("y").count().collect()  # one row for each label
    quotas = {r.y: quota.get(r.y, 0) if isinstance(quota, dict) else quota(len(counts)) for r in counts}
    # hashes are uniform: twice the quota lies below this, so that only as many rows are put in order
    cuts = [(r.y, n, min(2**63 - 1, int(2**64 * min(1.0, 2 * n / r["count"])) - 2**63)) for r in counts if (n := quotas[r.y])]
    if not cuts:
        return []
    kind = one.schema["y"].dataType.simpleString()
    below = one.join(F.broadcast(spark.createDataFrame(cuts, f"y {kind}, quota long, cut long")), "y").where("h <= cut")
    w = Window.partitionBy("y").orderBy("h")
    picked = below.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("quota")).select(*one.columns).collect()
    if not picked:
        return []
    those = spark.createDataFrame(picked, one.schema)
    those = those.select(*[F.col(c).alias(f"{c}_") for c in those.columns])
    # as many rows as the quotas allow
    full = docs.join(F.broadcast(those), docs.id.eqNullSafe(F.col("id_")) & (docs.h == F.col("h_")))
    rows = full.groupBy(F.col("y_").alias("y"), "h").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (r.h, str(r.y)))


def _hashed(docs: DataFrame) -> DataFrame:
    """(id, h, text), null texts left out."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return d.where("text is not null").select("id", F.xxhash64("text").alias("h"), "text")


def _split(rows: list) -> tuple[list, list, list, list]:
    hold = [r for i, r in enumerate(rows) if i % 5 == 4]
    keep = [r for i, r in enumerate(rows) if i % 5 != 4]
    return [r.text for r in keep], [r.y for r in keep], [r.text for r in hold], [r.y for r in hold]


def fit_language(docs: DataFrame, rows: int = LANGUAGE_ROWS) -> subword.Model:
    """From docs (doc_id, text, lang): an averaged subword embedding classifier, its temperature and its threshold of rejection."""
    d = docs.select("doc_id", "text", F.col("lang").cast("string").alias("y")).where("y is not null")
    h = d.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), "y").where(F.col("text").isNotNull())
    texts, langs, more, theirs = _split(sample(_hashed(d), h, lambda labels: max(LANGUAGE_LEAST, rows // max(1, labels))))
    model = subword.fit(texts, langs, subword.Bags(1 << 16, (2, 3, 4)), dim=8, epochs=4, rate=0.3, scale=10.0)
    return subword.calibrate(model, more, theirs)


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_ROWS, clean: int = CLEAN_ROWS) -> subword.Model:
    """From docs (doc_id, text) and labels (doc_id, toxic 0/1); a doc_id with both labels counts for neither."""
    one = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").alias("other")).where("y = other").drop("other")
    d = _hashed(docs)
    # narrow rows on both sides, joined in one way at every size
    marks = d.select("id", "h").join(one.hint("merge"), "id")
    texts, known, more, theirs = _split(sample(d, marks, {1: toxic, 0: clean}))
    model = subword.fit(texts, known, subword.Bags(), dim=4, epochs=4, least_df=LEAST_TEXTS)
    return subword.prune(model, more, theirs)


def _languages(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: subword.Model = model.value
        for batch in batches:
            text = subword.lowered(batch.column(batch.num_columns - 1))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(text), int), np.zeros(len(text))
            for lo, hi, words in C.pieces(text):
                p = m.probabilities(words)
                best[lo:hi], score[lo:hi] = p.argmax(1), p.max(1)
            known = letters & (m.classes[0] is not None)
            pred = [m.classes[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(known & (score >= m.accept))], [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: subword.Model, *keep: str) -> DataFrame:
    """The columns `keep` of docs (text), with lang_pred, score and accepted, for every row.

    A text that is null or has no letter is `und` with score 0; so is every text
    if the model knows no language. accepted is false where the calibrated score
    is below the model's threshold of rejection. Of languages that score the
    same, the first by name is predicted. Repeated rows are kept; a kept column
    that is named like a result is replaced by it.
    """
    C.small_batches(docs.sparkSession)
    d = C.scanned(docs, keep)
    schema = d.drop("_scanned").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    out = d.mapInArrow(_languages(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return C.renamed(out, keep, ("lang_pred", "score", "accepted"))


def _toxicity(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: subword.Model = model.value
        for batch in batches:
            text = subword.lowered(batch.column(batch.num_columns - 1))
            score = np.zeros(len(text))
            for lo, hi, words in C.pieces(text):
                p = m.probabilities(words)
                score[lo:hi] = p[:, 1] if p.shape[1] == 2 else float(m.classes[0] == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(score, 0, 1))], [*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, model: subword.Model, *keep: str) -> DataFrame:
    """The columns `keep` of docs (text) with score, 0 to 1, for every row.

    Null and empty texts get the score of no words; equal texts get equal
    scores; repeated rows are kept; a kept column named score is replaced.
    """
    C.small_batches(docs.sparkSession)
    d = C.scanned(docs, keep)
    out = d.mapInArrow(_toxicity(docs.sparkSession.sparkContext.broadcast(model)), d.drop("_scanned").schema.add("score", "double"))
    return C.renamed(out, keep, ("score",))


def less_toxic(docs: DataFrame, model: subword.Model, below: float) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the bound."""
    C.small_batches(docs.sparkSession)
    d = C.scanned(docs, tuple(docs.columns))
    out = d.mapInArrow(_toxicity(docs.sparkSession.sparkContext.broadcast(model)), d.drop("_scanned").schema.add("score", "double"))
    return out.where(F.col("score") < below).drop("score").toDF(*docs.columns)


def languages_of(docs: DataFrame, folds: int = 5, rows: int = LANGUAGE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learnt from the rows whose remainder isn't 0, applied to all."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_language(d.where(remainder(F.col("doc_id"), folds) != 0), rows)
    return identify(d.withColumn("held_out", remainder(F.col("doc_id"), folds) == 0), model, "doc_id", "held_out")


def toxicity_of(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from labelled rows whose remainder isn't 1, applied to all rows."""
    model = fit_toxicity(docs, labels.where(remainder(F.col("doc_id"), folds) != 1))
    out = toxicity(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, "doc_id")
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == 1).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

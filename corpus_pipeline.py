"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read back as the next one's docs.
All but the last return the columns of documents. ORACLE_SQL is None: learnt
models and latent search have no SQL; tests compare the stages with brute force.

Stages that filter take out rows, not ids: rows that share a doc_id are judged
by their own texts, and a row without a doc_id is judged like any other. Columns
beyond doc_id, text and source pass through, whatever their names. No rows in,
no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import classify, common, decontaminate, minhash_dedup, mixing, pii

ORACLE_SQL = None
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity, learnt from all labels, is below TOXIC.

    A null or empty text has the score of no words; equal texts go or stay
    together; a score of exactly TOXIC goes.
    """
    model = classify.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return classify.less_toxic(docs, model, TOXIC)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose (doc_id, hash of the text) is in gone (doc, body)."""
    same = docs.doc_id.cast("long").eqNullSafe(gone.doc) & F.xxhash64(docs.text.cast("string")).eqNullSafe(gone.body)
    return docs.join(gone, same, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id.

    Rows of that doc_id that are in the group, repeated rows among them, are
    that document and stay. Rows without a doc_id, text or words stay.
    """
    return _without(docs, minhash_dedup.grouped(docs).where("not kept").select("doc", "body").distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark; null and empty texts and items match nothing."""
    return _without(docs, decontaminate.leaking(docs, common.table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their personal data replaced; n_chars is that of the new text, null for a null text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with what the mix takes of them; nothing of a null or empty text. A null source is a source."""
    return mixing.mix(docs, text=False).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read back."""
    docs = common.table(spark, sf_dir, "documents")
    base = common.scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

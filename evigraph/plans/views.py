"""Views of the tables of a folder that the operators take: chunks, a code-like graph, commits, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunks(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part calls part: lines 1 and 2 of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("s"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("o"))
    return a.join(b, "l_orderkey").where("s <> o").groupBy("s", "o").agg(F.count("*").alias("w"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: path is the brand, language the type, lines the size."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Part#"), F.col("p_partkey")).alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("lines"))


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("c"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part tested by supplier."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("o")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers that nothing calls."""
    e = edges(spark, sf_dir)
    return e.select(F.col("s").alias("root")).distinct().join(e.select(F.col("o").alias("root")).distinct(), "root", "left_anti")


def first_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.min("s").alias("root"))


def first_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.min("o").alias("root"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("commit"), F.col("event_type").alias("file"))

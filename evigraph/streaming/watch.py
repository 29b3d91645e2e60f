"""Incremental ingest as streams over a folder of Parquet documents, and event-time aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evigraph.operators.ingest import chunks


def watch_documents(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks every new file of documents once and appends to out; the checkpoint remembers what was read, and a failed batch is tried again."""

    def batch(df: DataFrame, number: int) -> None:
        chunks(df.select("doc_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window; batch or stream. An extension: the operators above have no event time."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

"""Keyword, BM25, hashed and dense search, fusion, metrics, facets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.session import settle


def query_tokens(query: str, most: int) -> list[str]:
    return re.findall(r"[A-Za-z0-9]{2,}", query.lower())[:most]


def keyword_search(chunks: DataFrame, query: str, limit: int | None = 10, head: int = 240) -> DataFrame:
    """(id, score) of chunks (id, text) that hold all of the first eight tokens; score: the share of them in the first `head` characters."""
    words = query_tokens(query, 8)
    low = F.lower("text")
    hit, score = F.lit(bool(words)), F.lit(0)
    for w in words:
        hit = hit & low.contains(w)
        score = score + F.lower(F.substring("text", 1, head)).contains(w).cast("int")
    out = chunks.where(hit).select("id", F.round(score / max(1, len(words)), 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def bm25_search(chunks: DataFrame, query: str, limit: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 with the idf floored at 1e-6, over the query's first twelve tokens (any of them).

    Only the query's terms are counted; document lengths take one more count of tokens, no explode.
    """
    words = sorted(set(query_tokens(query, 12)))
    n = chunks.select("id", T.tokens(F.col("text")).alias("t"))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    n = n.select("id", F.size("t").alias("dl"), *[times(w).alias(f"tf_{i}") for i, w in enumerate(words)])
    total = n.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf_{i}") > 0).cast("int")).alias(f"df_{i}") for i in range(len(words))])
    score: Column = F.lit(0.0)
    for i in range(len(words)):
        df, tf = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    any_hit = " or ".join(f"tf_{i} > 0" for i in range(len(words))) or "false"
    out = n.where(any_hit).join(F.broadcast(total)).select("id", F.round(score, 6).alias("score"))  # total is one row
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def fuse(arms: dict[str, DataFrame], limit: int = 10, k: int = 60) -> DataFrame:
    """(id, score): the sum over arms (id, score) of 1 / (k + rank), ranks from 0 by score and id."""
    ranked = None
    for name, arm in arms.items():
        # arms are limited before they get here
        r = arm.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).select("id", (1 / (k + F.col("rank"))).alias("part"), F.lit(name).alias("arm"))
        ranked = r if ranked is None else ranked.unionAll(r)
    out = ranked.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Keyword and BM25 arms, each over-fetched threefold, fused by reciprocal rank."""
    return fuse({"keyword": keyword_search(chunks, query, 3 * limit), "bm25": bm25_search(chunks, query, 3 * limit)}, limit)


def hashed_vectors(chunks: DataFrame, dim: int = 256) -> DataFrame:
    """(id, idx, w): unit vectors of hashed token counts, sparse."""
    tf = chunks.select("id", F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("id", T.hash_index(F.col("t"), dim).alias("idx")).agg(F.count("*").alias("tf"))
    norm = tf.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norm, "id").select("id", "idx", (F.col("tf") / F.col("norm")).alias("w"))


def similarity_search(chunks: DataFrame, query: str, limit: int = 10, dim: int = 256) -> DataFrame:
    """(id, score): cosine of hashed vectors with the query's."""
    asked = hashed_vectors(chunks.sparkSession.createDataFrame([("q", query)], "id string, text string"), dim)
    asked = asked.select("idx", F.col("w").alias("qw"))
    out = hashed_vectors(chunks, dim).join(F.broadcast(asked), "idx").groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


# Vectors of up to so many features are compared as dense blocks; so many vectors make a block worth dealing, in so many blocks at most.
DENSE, BLOCK_ROWS, BLOCKS = 1024, 1024, 32
# Bytes of a strip of dense vectors.
STRIP = 1 << 21


def similar_pairs(chunks: DataFrame, threshold: float = 0.9, dim: int = 256) -> DataFrame:
    """(a, b, score): all pairs of hashed vectors with a cosine of the threshold or more.

    Few features are dense, so each pair of vectors shares some: blocks of
    vectors are multiplied, a task has two blocks. Many features go through a
    prefix filter.
    """
    return _blocked(hashed_vectors(chunks, dim), threshold, dim) if dim <= DENSE else _prefixed(hashed_vectors(chunks, dim), threshold)


def _blocked(v: DataFrame, threshold: float, dim: int) -> DataFrame:
    """All pairs by blocks: work is quadratic, what a task holds is two blocks and the pairs of two strips."""
    kind = v.schema["id"].dataType.simpleString()
    x = settle(v.where("id is not null").groupBy("id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "w")).alias("v")).select("id", F.col("v.idx").alias("idx"), F.col("v.w").alias("w")))
    blocks = min(BLOCKS, 1 + x.count() // BLOCK_ROWS)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    meet = x.select("id", "idx", "w", own.alias("own"), other.alias("other")).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def dense(t: pa.Table) -> np.ndarray:
        idx, w = t.column("idx").combine_chunks(), t.column("w").combine_chunks()
        out = np.zeros((len(t), dim))
        out[np.repeat(np.arange(len(t)), np.diff(idx.offsets.to_numpy())), idx.flatten().to_numpy()] = w.flatten().to_numpy()
        return out

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches)).sort_by("id")  # in the order of bytes, as Spark has it
        ids = t.column("id").combine_chunks()
        at = t.column("own").to_numpy()
        left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        rows = max(1, STRIP // (8 * dim))
        for i in range(0, len(left), rows):
            p = left[i : i + rows]
            first = dense(t.take(pa.array(p)))
            for j in range(i if lo == hi else 0, len(right), rows):
                q = right[j : j + rows]
                dot = first @ dense(t.take(pa.array(q))).T
                x, y = np.nonzero(dot >= threshold - 1e-6)
                dot, x, y = dot[x, y], p[x], q[y]
                keep = x < y if lo == hi else np.ones(len(x), bool)
                a, b = (ids.take(pa.array(f(x, y)[keep])) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(dot[keep])], ["a", "b", "score"])

    tasks = blocks * (blocks + 1) // 2
    pairs = meet.select("id", "idx", "w", "own", "lo", "hi").repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInArrow(run, f"a {kind}, b {kind}, score double")
    return pairs.select("a", "b", F.round("score", 6).alias("score")).where(F.col("score") >= threshold)


def _prefixed(v: DataFrame, threshold: float) -> DataFrame:
    """Prefix filter: a vector is looked up only by its rarest features, whose squares are more than 1 - threshold^2 of its length; similar vectors share one."""
    df = v.groupBy("idx").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id").orderBy("df", "idx").rowsBetween(Window.unboundedPreceding, -1)
    # what comes after the prefix has a length below the threshold, so a pair must meet in a prefix
    rare = v.join(df, "idx").withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(w), F.lit(0.0))).where(F.col("before") <= 1 - threshold**2 + 1e-9)
    x, y = rare.select("idx", F.col("id").alias("a")), v.select("idx", F.col("id").alias("b"))
    pairs = x.join(y, "idx").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dot = pairs.join(v.withColumnsRenamed({"id": "a", "w": "wa"}), "a").join(v.withColumnsRenamed({"id": "b", "w": "wb"}), ["b", "idx"])
    return dot.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("score")).where(F.col("score") >= threshold)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size == 0, 1.0).otherwise(size)


def dense_search(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(id, score) by cosine, of vectors (id, embedding): a scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranking_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row: mrr, recall, ndcg at k, of ranked (query, rank from 1, relevant 0/1, n_relevant)."""
    gain = F.when((F.col("rank") <= k) & (F.col("relevant") == 1), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + math.log(2) / F.log(i + 1))
    per = ranked.groupBy("query").agg(
        F.max(F.when(F.col("relevant") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)).alias("hit"),
        F.sum(gain).alias("dcg"),
        F.max("n_relevant").alias("n"),
    )
    per = per.select("rr", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("recall"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
    return per.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("rr", "mrr"), ("recall", "recall"), ("ndcg", "ndcg"))])


def facet(df: DataFrame, key: Column, name: str = "bucket") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def identifier_match(wanted: list[str], parts: Column) -> Column:
    """The share of the wanted identifiers (dotted or camel) whose parts are consecutive among `parts`."""
    hits = F.lit(0)
    for name in wanted:
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name))
        q = [p for p in re.split(r"[^a-z0-9]+", s.lower()) if p]
        want = F.array(*[F.lit(p) for p in q])
        ahead = F.sequence(F.lit(1), F.greatest(F.size(parts) - len(q) + 1, F.lit(1)))
        at = lambda n, w: lambda i: F.slice(parts, i, n) == w
        hits = hits + F.exists(ahead, at(len(q), want)).cast("int")
    return F.round(hits / max(1, len(wanted)), 6)


def identifier_arm(names: DataFrame, wanted: list[str], limit: int = 20) -> DataFrame:
    """(id, score) of names (id, name): the share of the wanted identifiers that a name's parts hold, nothing else."""
    x = names.select("id", identifier_match(wanted, T.split_identifier(F.col("name"))).alias("score")).where("score > 0")
    return x.orderBy(F.desc("score"), "id").limit(limit)


def boosted(hits: DataFrame, wanted: list[str], limit: int = 10) -> DataFrame:
    """(id, score) of a bounded list of hits (id, score, name): matches of identifiers move up by the mean gap between neighbours."""
    gap = hits.agg(((F.max("score") - F.min("score")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("gap"))
    x = hits.withColumn("m", identifier_match(wanted, T.split_identifier(F.col("name")))).join(F.broadcast(gap))
    return x.select("id", F.round(F.col("score") + F.col("gap") * F.col("m"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def federated(roots: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """(root, id, score): the best of each root (id, score), merged."""
    out = None
    for name, hits in roots.items():
        own = hits.orderBy(F.desc("score"), "id").limit(limit).select(F.lit(name).alias("root"), "id", "score")
        out = own if out is None else out.unionAll(own)
    return out.orderBy(F.desc("score"), "root", "id").limit(limit)

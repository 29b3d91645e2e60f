"""Mixing sources to target weights over fixed-length blocks.

The words of a source, document after document, are packed into blocks of
`block` words. Every output shard draws multinomial counts over the sources from
what is left of their quotas, so a shard is random and the whole is on target:
the shards are the leaves of a tree, each node of which draws, by its own seed,
what its left half takes of its quotas. A task walks the tree to its own shards
alone, so no table of shards is ever made. A source's draws are numbered through all shards; draw i takes the block that a
keyed pseudorandom permutation of the source's block indices (a new one for each
pass over the source) has at i. Blocks are then joined by source and index.

No source is gathered anywhere: a document's place in its source is the sum of
the buckets before its own plus the documents before it in its bucket. One row
per source is on the driver and broadcast, at most MAX_SOURCES of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 4096  # a source's documents are ordered within so many buckets
MAX_SOURCES = 1_000_000
_WEIGHTS = (1, 2, 3)  # in turn, over the sources by name


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """All of the sum of sizes, shared by weight, no source above `most` times its size."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def _share(quotas: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """n of the quotas: multinomial counts by what is left of each, none above its quota."""
    rng, got = np.random.default_rng(seed), np.zeros_like(quotas)
    while n:
        room = quotas - got
        more = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got += more
        n -= int(more.sum())
    return got


def draws(quotas: np.ndarray, per_shard: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, their counts, what earlier shards took of them) of the shards from first to last.

    All shards but the last hold per_shard; the counts of a source add up to its quota.
    """
    shards = -(-int(quotas.sum()) // per_shard)
    some = np.flatnonzero(quotas)
    todo = [(0, shards, some, quotas[some], np.zeros(len(some), np.int64))] if shards else []
    while todo:
        lo, hi, who, left, taken = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, who, left, taken
            continue
        mid = (lo + hi) // 2
        got = _share(left, (mid - lo) * per_shard, [seed, lo, hi])
        rest = left - got
        a, b = got > 0, rest > 0
        todo += [(mid, hi, who[b], rest[b], (taken + got)[b]), (lo, mid, who[a], got[a], taken[a])]


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of i under keyed permutations of range(n): a Feistel network that walks its cycles back into the range."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))
    half = C.U(1) * ((bits + 1) // 2).astype(C.U)
    mask = (C.U(1) << half) - C.U(1)
    out, todo = i.astype(C.U), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        x, y = out[todo] >> h, out[todo] & m
        for r in range(4):
            x, y = y, x ^ (C.mix(y + k + C.U(r << 56)) & m)
        out[todo] = (x << h) | y
        todo = todo[out[todo] >= n[todo].astype(C.U)]
    return out.astype(np.int64)


def _slots(sources: Broadcast, per_shard: int, seed: int) -> Callable:
    """From consecutive shard numbers, the shards' slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas, blocks = sources.value
        one = lambda x: C.mix(np.array([x], C.U))[0]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for shard, who, counts, begin in draws(quotas, per_shard, seed, int(ids.min()), int(ids.max()) + 1) if len(ids) else ():
                rank = np.repeat(who, counts)
                size, within = len(rank), np.arange(len(rank)) - np.repeat(np.cumsum(counts) - counts, counts)
                turn, n = np.repeat(begin, counts) + within, blocks[rank]
                key = C.mix((turn // n).astype(C.U) + (rank.astype(C.U) << C.U(32)) + one(seed))
                index = permuted(turn % n, n, key)
                place = permuted(np.arange(size), np.full(size, size), np.full(size, one(seed + 1 + (shard << 20))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, shard, np.int64)), pa.array(rank), pa.array(index), pa.array(place)], ["shard", "rank", "block", "place"])

    return run


@dataclass
class Mix:
    """docs: the input with rank, size, begin (its first word in its source); sources: one row each; slots: the output."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """(rank, block, begin, at, words): what a document has in a block, from its word `at`."""
        d = self.docs.where("size > 0").select("rank", "begin", "size").withColumn("block", F.explode(F.expr(f"sequence(begin div {self.block}, (begin + size - 1) div {self.block})")))
        lo, hi = f"greatest(begin, block * {self.block})", f"least(begin + size, (block + 1) * {self.block})"
        return d.selectExpr("rank", "block", "begin", f"{lo} - begin as at", f"{hi} - {lo} as words")

    def taken(self) -> DataFrame:
        """docs with source_size, target and taken: the words that the mix takes, repeats counted."""
        # all three grow with the documents, so none is ever broadcast
        times = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")
        took = self.pieces().join(times, ["rank", "block"]).groupBy("rank", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken")).hint("merge")
        out = self.docs.withColumn("begin", F.when(F.col("size") > 0, F.col("begin"))).join(took, ["rank", "begin"], "left")
        return out.join(F.broadcast(self.sources.select("rank", "source_size", "target")), "rank").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def texts(self) -> DataFrame:
        """(shard, place, rank, text): the mixed blocks themselves, words joined by spaces."""
        words = self.docs.select("rank", "begin", F.regexp_extract_all("text", F.lit(C.WORD), F.lit(0)).alias("w"))
        part = self.pieces().join(words.hint("merge"), ["rank", "begin"]).withColumn("t", F.array_join(F.slice("w", F.col("at").cast("int") + 1, F.col("words").cast("int")), " "))
        block = part.groupBy("rank", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "t"))), lambda x: x["t"]), " ").alias("text"))
        return self.slots.join(block.hint("merge"), ["rank", "block"]).select("shard", "place", "rank", "text")


def mix(docs: DataFrame, block: int = 64, weights: tuple[float, ...] = _WEIGHTS, most: float = 3.0, per_shard: int = 8192, seed: int = 1, text: bool = True) -> Mix:
    """Mixes docs (doc_id, text, source); sources by name, null last, weigh `weights` in turn.

    A null or empty text has size 0 and is never taken. Rows that share a doc_id
    are documents of their own; equal rows are interchangeable. A null source is
    a source. The outcome depends on the rows and the parameters alone, not on
    partitions. Columns of docs other than these three are left out; no rows, no
    slots.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long")).withColumn("tie", F.xxhash64("text"))
    base = C.scratch(spark)
    sized = C.settle(d.select("doc_id", "source", "size", "tie").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(BUCKETS))), f"{base}/sized")
    totals = C.settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")), f"{base}/totals")
    rows = totals.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.n for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    quotas = np.array([round(t * b / n) if n else 0 for t, b, n in zip(goal, blocks.tolist(), sizes, strict=True)], np.int64)
    table = spark.createDataFrame([(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(rows, goal, strict=True))], "source string, rank long, source_size long, target double")
    shards = -(-int(quotas.sum()) // per_shard) if len(rows) else 0
    own = spark.sparkContext.broadcast((quotas, blocks))
    slots = spark.range(0, shards, 1, max(1, min(shards, C.shuffle_partitions(spark)))).mapInArrow(_slots(own, per_shard, seed), "shard long, rank long, block long, place long")
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    # equal rows stand for each other: they are put in order once, with their number
    same = sized.groupBy("source", "bucket", "doc_id", "size", "tie").agg(F.count("*").alias("copies"))
    along = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(along), F.lit(0)))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("within", F.col("within") + F.col("size") * F.col("copy"))
    b = before.withColumnsRenamed({"source": "s2", "bucket": "b2"}).hint("merge")
    placed = placed.join(b, placed.source.eqNullSafe(b.s2) & (placed.bucket == b.b2)).withColumn("begin", F.col("within") + F.coalesce("before", F.lit(0)))
    t = table.select(F.col("source").alias("s3"), "rank")
    placed = placed.join(F.broadcast(t), placed.source.eqNullSafe(t.s3)).select("doc_id", "source", "size", "tie", "rank", "begin")
    if text:
        w = Window.partitionBy("doc_id", "source", "tie").orderBy("begin")
        same = Window.partitionBy("doc_id", "source", "tie").orderBy("size")
        n, o = placed.withColumn("k", F.row_number().over(w)), d.select("doc_id", "source", "tie", "text", F.row_number().over(same).alias("k"))
        on = [n[c].eqNullSafe(o[c]) for c in ("doc_id", "source", "tie", "k")]
        placed = n.join(o, on).select(n.doc_id, n.source, n.size, n.rank, n.begin, o.text)
    return Mix(placed, table, slots, block)

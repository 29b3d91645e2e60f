"""What the operators of this subpackage share: tables, scratch space, word kernels.

Word kernels work on the raw UTF-8 bytes of an Arrow string column, so that a
word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  They take
about a megabyte of text at a time, whatever the size of a batch or a text.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at a time.
PIECE = 1 << 20
#: Bytes of a word up to which its hash is a polynomial.
LONG = 64
#: A word, as the contracts define it, for Java, RE2 and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 11, 12, 13]] = 32
_LOWER = _BLANK.copy()
_LOWER[65:91] += 32

U = np.uint64


# ------------------------------------------------------------------ session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; removed when the driver's JVM ends.

    A temporary folder of this machine serves only where ``spark.checkpoint.dir`` is unset, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(scratch, "local", None)
        if base is None:
            base = scratch.local = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    path = f"{base.rstrip('/')}/evigraph-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return path


def settle(df: DataFrame, path: str) -> DataFrame:
    """Writes df to path and reads it back: later stages start from files that survive any executor."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's input, from file sizes; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to 16 MB where the session has not set a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, "16m")


def scanned(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns to keep, under names of their own, and the text last."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_scanned"))


def renamed(out: DataFrame, keep: tuple[str, ...], results: tuple[str, ...]) -> DataFrame:
    """Kept columns by their names; a kept column named like a result gives way to it."""
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep) if c not in results], *results)


# -------------------------------------------------------------- word kernels


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_BYTE, _WORD = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


class Words:
    """The words of some rows of text.

    buf: bytes, white space turned into spaces; starts, ends: of each word in buf;
    first: index of each row's first word, and the number of words at the end.
    """

    __slots__ = ("buf", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, fold: np.ndarray | None = None):
        """fold: a table of bytes to use instead; what it maps to a space is white space."""
        self.buf = ((_LOWER if lower else _BLANK) if fold is None else fold)[data]
        n = len(data)
        ws = self.buf == 32
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = ~ws
        stop = begin.copy()
        begin[1:] &= ws[:-1] | edge[1:n]
        stop[:-1] &= ws[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def squeeze(self) -> Words:
        """One space between the words of a row, nothing else."""
        if not len(self):
            return self
        gap = np.ones(len(self), np.int64)
        gap[self.first[1:][self.counts > 0] - 1] = 0
        if np.array_equal(self.starts[1:], (self.ends + gap)[:-1]):
            return self
        size = self.ends - self.starts + gap
        begin = np.cumsum(size) - size
        keep = ~_WS[self.buf]
        keep[self.ends[gap > 0]] = True
        self.buf, self.ends, self.starts = self.buf[keep], begin + (self.ends - self.starts), begin
        return self

    def hashes(self) -> np.ndarray:
        """64 bits for each word, a function of its bytes alone.

        A polynomial modulo 2^64 for words of up to LONG bytes; beyond, there are words that any such polynomial confuses, so those take a cryptographic hash.
        """
        out = np.empty(len(self), U)
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + PIECE, "right")))
            lo, hi = self.starts[i], self.ends[j - 1]
            if hi - lo > PIECE:
                i += 1
                continue
            up, down = _BYTE(hi - lo + 1)
            c = np.zeros(hi - lo + 1, U)
            np.cumsum((self.buf[lo:hi].astype(U) + U(1)) * up[:-1], out=c[1:])
            s = self.starts[i:j] - lo
            out[i:j] = mix((c[self.ends[i:j] - lo] - c[s]) * down[s])
            i = j
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words that lie in one row, and where each begins."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, np.int64)
        up, down = _WORD(len(h) + 1)
        c = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[:-1], out=c[1:])
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= last[:n])
        return mix((c[at + k] - c[at]) * down[at] + U(k)), at


def pieces(values: pa.Array | pa.ChunkedArray, lower: bool = False, fold: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their words) for about PIECE bytes of rows at a time; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    n = len(values)
    _, at, data = values.buffers()
    offsets = np.frombuffer(at, np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        o = offsets[lo : hi + 1]
        yield lo, hi, Words(data[o[0] : o[-1]], o - o[0], lower, fold)
        lo = hi


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """buf[s:e] for all s and e, one after the other."""
    size = ends - starts
    total = int(size.sum())
    step = np.ones(total, np.int64)
    if total:
        full = size > 0
        s, n = starts[full], size[full]
        at = np.cumsum(n) - n
        step[at] = s
        step[at[1:]] -= s[:-1] + n[:-1] - 1
    return buf[np.cumsum(step)] if total else buf[:0]


def ids_of(column: pa.Array) -> np.ndarray:
    """int64, null as the largest."""
    return pc.fill_null(column.cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False)


# ------------------------------------------------------ connected components


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id but its component's smallest, with that smallest: numpy min-label with pointer jumping."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, a bounded number at a time, as stars to the smallest id."""
    a = b = np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 2_000_000:
            a, b = _forest(a, b)
            if len(a) > 1_000_000:
                yield out()
                a = b = np.empty(0, np.int64)
    if len(a):
        a, b = _forest(a, b)
        yield out()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all ends of the edges of a partition."""
    table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    if table.num_rows:
        v, root = _forest(table.column("a").to_numpy(), table.column("b").to_numpy())
        low = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, low])), pa.array(np.concatenate([root, low]))], ["id", "component"])


def components(edges: DataFrame, rounds: int = 40, together: int = 0) -> DataFrame:
    """(id, component) of every end of the edges (a long, b long): component is the smallest id reachable.

    Where the partitions' contracted edges are no more than `together`, one task
    joins them up; rounds of joins over many partitions would cost more than that.

    Alternating large and small stars; every partition first contracts its own
    edges. A hub's edges are never gathered: minima are aggregated before the
    shuffle, and the join back to a hub can be split. Each round is a table in
    the shared folder. Loops and repeated edges do no harm; no edges, no rows.
    """
    spark = edges.sparkSession
    base = scratch(spark)
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = settle(edges.mapInArrow(_contract, "a long, b long"), f"{base}/0")
    if together and now.count() <= together:
        return settle(now.coalesce(1).mapInArrow(_labelled, "id long, component long"), f"{base}/labels")
    for k in range(1, rounds):
        ends = now.select(F.col("a").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(now.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("id").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x > 1 or (x > 0 and y > 0)")
        if loose.isEmpty():
            break
        both = now.unionAll(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least)
        now = settle(small.mapInArrow(_contract, "a long, b long").distinct(), f"{base}/{k}")
        discard(spark, f"{base}/{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.toDF("id", "component").unionAll(now.select("b", "b").distinct())

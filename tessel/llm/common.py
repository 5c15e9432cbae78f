"""Shared plumbing of the training-data operators: staging, text keys, Arrow helpers, components.

Staged tables are Parquet written below ``spark.checkpoint.dir`` (a folder that all executors share). They cut
lineage: a lost executor rereads files instead of recomputing text passes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only where the setting is absent and Spark is local (as in tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is still there is deleted when the driver ends."""
    if not _WRITTEN:
        atexit.register(_drop_all)
    _WRITTEN.append(f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with suppress(Exception):  # the driver is ending
            drop(spark, list(_WRITTEN))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was staged inside, but for the paths put into the list that it gives. What is kept mustn't read the rest any more."""
    before, keep = len(_WRITTEN), []
    yield keep
    drop(spark, [p for p in _WRITTEN[before:] if p not in keep])


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text as two longs; rows with equal texts share it, and so all that follows from the text."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """A pyarrow schema of a short DDL with the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that only few texts exist as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def small(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000, most_rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded size, a row at least."""
    for b in batches:
        n = b.num_rows
        if b.nbytes <= most_bytes and n <= most_rows:
            yield b
            continue
        at = 0
        while at < n:
            size = min(most_rows, n - at)
            while size > 1 and b.slice(at, size).nbytes > most_bytes:
                size = (size + 1) // 2
            yield b.slice(at, size)
            at += size


class Rows:
    """Collects output rows by column and hands out Arrow batches of a bounded size."""

    def __init__(self, ddl: str, most: int = 20_000, most_bytes: int = 8_000_000) -> None:
        self.schema, self.most, self.most_bytes = arrow_schema(ddl), most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.columns, self.n, self.bytes = [[] for _ in self.schema], 0, 0

    def add(self, *values: object, weight: int = 0) -> bool:
        for column, v in zip(self.columns, values, strict=True):
            column.append(v)
        self.n += 1
        self.bytes += weight
        return self.n >= self.most or self.bytes >= self.most_bytes

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            out = pa.record_batch([pa.array(c, t.type) for c, t in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.clear()
            yield out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    return df.mapInArrow(fn, ddl)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all windows of an array, from one running sum.

    sum of v[j] * B**(n-1-j) over a window is (S[i+n] - S[i]) * B**(i+n-1) for S the prefix sums of v[j] * B**-j, as B is odd.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse, self.up, self.down = base | 1, pow(base | 1, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, 2 * len(self.up), 4096)
        for name, b in (("up", self.base), ("down", self.inverse)):
            out, have = np.empty(n, np.uint64), 1
            out[0] = 1
            with np.errstate(over="ignore"):
                while have < n:  # doubles: B**(have + i) is B**have * B**i
                    m = min(have, n - have)
                    out[have : have + m] = out[:m] * np.uint64(pow(b, have, 1 << 64))
                    have += m
            setattr(self, name, out)

    def windows(self, values: np.ndarray, n: int) -> np.ndarray:
        """One well-mixed hash for each start 0 .. len(values) - n."""
        m = len(values) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(values) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values.astype(np.uint64) * self.down[: len(values)], out=sums[1:])
            return mix((sums[n:] - sums[:-n]) * self.up[n - 1 : n - 1 + m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling: log2(w) passes."""
    if len(x) < w:
        return np.empty(0, x.dtype)
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == w else np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges(u, v), component being the least node; nulls and loops are ignored.

    Alternates large-star and small-star steps until nothing changes. Each step is two shuffles over the edges; a hub's
    minimum is pre-aggregated and joined back, so no task gathers its neighbours. Every state is staged.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = stage(e, "edges", path)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").where("v > m").union(low.select("u", "m")).toDF("u", "v").distinct()
        old, path = path, new_path(spark, "edges")
        e = stage(small, "edges", path)
        was, seen = seen, mark(e)
        drop(spark, [old])
        if was == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))

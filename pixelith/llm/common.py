"""What the operators share: table access, Arrow batch limits, shared storage, text buffers, global ranks."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelith import reachable

#: Bytes of text that one numpy pass holds at a time, unless a single text is longer.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(name: str, taken) -> str:
    """name, with underscores before it until no column in `taken` begins with it."""
    while any(t.lower().startswith(name.lower()) for t in taken):
        name = "_" + name
    return name


#: Rows and bytes of the Arrow batches that go to Python workers: one setting for all operators, so that a lazy result
#: runs under the same limits whatever has been called since.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches by rows and bytes."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode, where
    driver and executors are one process, and an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        path = getattr(shared_dir, "fallback", None) or f"file://{tempfile.mkdtemp(prefix='pixelith')}"
        shared_dir.fallback = path
    return path.rstrip("/")


#: Paths of the tables stored inside each scratch(), innermost last.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    Inside scratch() the table goes when that ends; with keep, when the scratch() around it ends, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _SCRATCH[:-1] if keep else _SCRATCH
    if owners:
        owners[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, so what leaves it must be stored with keep, or be no DataFrame."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            removed(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, for results that are read after a function has returned: Spark deletes its
    files once nothing refers to them, where spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are stored: it does so for objects collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


CODEC = pa.Codec("zstd", compression_level=3)


def squeeze(raw) -> bytes:
    """Compressed bytes with their size before them."""
    raw = bytes(raw)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def expand(raw) -> bytes:
    raw = memoryview(raw)
    return CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a string column: the UTF-8 bytes as one array, and n + 1 offsets. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]] if len(ends) else raw[:0], ends - (ends[0] if len(ends) else 0)


def passes(ends: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together; a longer row comes alone."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order; sorts x in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shuffled(key: Column) -> Column:
    """A number below 2 ** 60 that stands for the key in a random order: the first 15 hex digits of the md5 of its text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def hash_prefix(df: DataFrame, groups: list[str], key: Column, parts: int, weight: Column, out: str = "before") -> DataFrame:
    """Adds the sum of weight over the rows before a row in its group, in order of shuffled(key) and key itself.

    The order falls into `parts` equal ranges of that number, so it is the same for any number of parts. Sums inside a (group, range) come from a window over
    that small part; the sums of the ranges before it are joined on. So a group of any size spreads over all ranges,
    and both passes see the same order, as it depends on values alone. With weight 1 this is a gapless rank from 0.
    Rows whose key is equal follow one another in any order. df should be a stored table: it is read twice.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    work = df.withColumns({"_h": shuffled(key), "_w": weight.cast("long")}).withColumn("_part", F.expr(f"cast(shiftright(shiftright(_h, 28) * {parts}L, 32) as int)"))
    sums = work.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_part").alias("_p")).agg(F.sum("_w").alias("_n"))
    ahead = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = sums.select(*names, "_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy(*groups, "_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    summed = work.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    on = summed["_part"] == ahead_of["_p"]
    for g, n in zip(groups, names, strict=True):
        on &= summed[g].eqNullSafe(ahead_of[n])
    joined = summed.join(ahead_of, on)
    return joined.withColumn(out, F.col("_ahead") + F.col("_in")).drop("_h", "_w", "_part", "_p", "_in", "_ahead", *names)

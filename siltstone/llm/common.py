"""What the operators of this package share: reading, materialising, size-checked broadcasts, local bindings."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (at most a few dozen bytes a row) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, named by the cluster in spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_siltstone_dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = sc._siltstone_dir = tempfile.mkdtemp(prefix="siltstone-")
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    Survives lost executors, since the files are not theirs, and is read by column, unlike an RDD checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted here unless given), else df as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df.hint("shuffle_merge")


def document_key() -> Column:
    """What a document is known by in joins, never null: its doc_id, which may be null, and the hash of its text, so that only identical rows share a key."""
    return F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often and wherever body uses it."""
    return F.transform(F.array(value), body)[0]


#: Items that scan goes through before it hands on what it has.
SCAN = 64


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each item: zero, step(zero, item 0), step(that, item 1), ... without zero.

    Appending copies what is there, so states are gathered SCAN at a time, and these blocks then."""

    def block(a: Column, part: Column) -> Column:
        start = F.struct(a["state"].alias("state"), F.array_repeat(a["state"], 0).alias("out"))

        def one(b: Column, x: Column) -> Column:
            return let(step(b["state"], x), lambda now: F.struct(now.alias("state"), F.array_append(b["out"], now).alias("out")))

        done = F.aggregate(part, start, one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(a["out"], d["out"]).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCAN).cast("int")), lambda k: F.slice(items, k * SCAN + 1, SCAN))
    start = F.struct(zero.alias("state"), F.array_repeat(F.array_repeat(zero, 0), 0).alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(parts, start, block, lambda a: a["out"]))).otherwise(F.array_repeat(zero, 0))


def give_back() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released_after(run: Callable) -> Callable:
    """run, a function on the driver, giving back what it freed."""

    @functools.wraps(run)
    def whole(*args, **named):
        try:
            return run(*args, **named)
        finally:
            give_back()

    return whole


def released(run: Callable) -> Callable:
    """run, a function over a task's batches, giving the memory that it freed back to the system at its end: Python workers outlive their tasks."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows at most: a batch of texts lies in memory twice, in the JVM and in Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df

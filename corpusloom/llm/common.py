"""Shared helpers: the shared folder, tables written there, column hygiene, and Python workers that give memory back."""

from __future__ import annotations

import ctypes
import functools
import itertools
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load, shared_folder

table = load

#: Bytes of a batch that goes to Python, unless one row has more, and rows that a Parquet reader holds at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512

#: Ids that are broadcast at most (8 MB, some 50 MB as a hash table); more are joined by a shuffle.
MAX_IDS = 1_000_000

#: Has Spark delete a query's shuffle files when it is over; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of tables that ``stash`` wrote.
_written: weakref.WeakKeyDictionary[DataFrame, list[str]] = weakref.WeakKeyDictionary()


def stash(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _written[found] = [path]
    return found


def union(parts: list[DataFrame]) -> DataFrame:
    """The union of written tables, which ``discard`` takes as one."""
    both = functools.reduce(DataFrame.unionByName, parts)
    _written[both] = [path for p in parts for path in _written.get(p, [])]
    return both


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``stash`` wrote, once nothing will read it; other tables are left alone."""
    for df in tables:
        for path in _written.pop(df, []) if df is not None else []:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` with null text as the empty string; other columns are pruned."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not: ``name``, with as many ``_`` before it as it takes; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most ``MAX_IDS`` rows; else it joins by a shuffle."""
    return F.broadcast(ids) if ids.limit(MAX_IDS + 1).count() <= MAX_IDS else ids


def passes(ids: DataFrame, key: str, other: str | None = None) -> list[Column]:
    """Conditions that split a written table of ids into ranges of about ``MAX_IDS`` rows by ``key``, or another table by its column ``other``; nulls are in the first.

    Rows of long texts meet one range's ids at a time by a broadcast, so they are never shuffled. A Parquet reader skips
    row groups outside a range: texts stored by ascending key are read about once in all, others once a range.
    """
    n = -(-ids.count() // MAX_IDS)
    if n <= 1:
        return [F.lit(True)]
    at = sorted(set(ids.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("at")).first()["at"]))
    x = F.col(other or key)
    return [x.isNull() | (x <= at[0]), *[(x > a) & (x <= b) for a, b in itertools.pairwise(at)], x > at[-1]]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # only glibc has it
        return None


def release() -> None:
    """Gives a Python worker's freed memory back to the system; workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Limits what is read and sent to Python at once in this session, so that long texts come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, that releases its worker's memory behind each partition."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)

"""Streams: append with resume by key, one-shot receipts, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over one table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def append_new(batch: DataFrame, sink: str, key: str, identity: str | None = None) -> None:
    """Appends a batch's rows whose key the sink lacks; the first of each key. Safe to repeat.

    With ``identity`` a row whose key is there under another identity stops the batch.
    """
    spark = batch.sparkSession
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in batch.columns if c != key]))).where("_r = 1").drop("_r")
    try:
        done = spark.read.schema(batch.schema).parquet(sink)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], batch.schema)
    if identity:
        other = first.join(done.select(key, F.col(identity).alias("_i")), key).where(F.col(identity) != F.col("_i"))
        if other.head(1):
            raise ValueError("a record exists under another identity")
    first.join(done.select(key), key, "left_anti").write.mode("append").parquet(sink)


def run_appending(stream: DataFrame, sink: str, checkpoint: str, key: str, identity: str | None = None) -> None:
    """Runs what is available and stops; the checkpoint lets a later run go on from there."""
    query = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, sink, key, identity)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def once(spark: SparkSession, receipt: str, result: DataFrame) -> None:
    """Writes a result that must be made only once: an existing receipt refuses it."""
    result.write.mode("errorifexists").parquet(receipt)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str, value: Column) -> DataFrame:
    """Counts and sums by tumbling window and key, with a watermark for late rows."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def collect_stream(out: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """A complete-mode aggregate, run over what is available and written batch by batch."""
    query = out.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.parquet(sink)


def sessions(events: DataFrame, user: str, time: str, gap: str) -> DataFrame:
    """Sessions of a user that a gap ends."""
    return events.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")

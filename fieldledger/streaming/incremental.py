"""Structured Streaming twins of the incremental batch operators.

All of them read files as they arrive (``availableNow`` drains what is there and
stops, a processing-time trigger keeps going) and keep their checkpoints and
tables under the shared checkpoint folder. Each gives the rows of its batch twin.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ensure_checkpoint_dir
from .log import FAN, UpdateLog


def arriving(spark: SparkSession, folder: str, schema, files: str = "*.parquet",
             files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, by name pattern, as they appear."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def workspace(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _drain(writer, base: str):
    query = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_ingest_latest(stream: DataFrame, keys: list[str], order: list[str], base: str, fan: int = FAN) -> DataFrame:
    """Idempotent ingest, last write wins.

    Each micro-batch is reduced to its latest row per key and added to an update log, which is merged as it
    grows; a replayed batch changes nothing. Readers see the latest row per key over all batches. Started
    again on the same folder, the stream goes on where it stood.
    """
    log = UpdateLog(f"{base}/log", stream.schema, keys, order, fan)
    _drain(stream.writeStream.foreachBatch(log.append), base)
    return log.latest(stream.sparkSession)


def daily_stats(events: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Daily aggregation shared by the stream and its batch twin."""
    day = F.window(ts, "1 day")
    return events.groupBy(day, *keys).agg(F.count("*").alias("n"), F.max("value").alias("high"),
                                          F.min("value").alias("low"), F.avg("value").alias("mean")) \
        .select(F.to_date("window.start").alias("day"), *keys, "n", "high", "low", "mean")


def stream_daily_conditions(stream: DataFrame, ts: str, keys: list[str], base: str, late: str = "6 hours",
                            fan: int = FAN) -> DataFrame:
    """Days as they stand after every batch, those still open included: updates go to a log, where the
    newest row of a day and key is the current one."""
    return _current(daily_stats(stream.withWatermark(ts, late), ts, keys), ["day", *keys], f"{base}/days", base, fan)


def _current(updates: DataFrame, keys: list[str], folder: str, base: str, fan: int) -> DataFrame:
    """Drains an aggregation in update mode and returns the newest row of each key."""
    schema = T.StructType([*updates.schema.fields, T.StructField("seq", T.LongType())])
    log = UpdateLog(folder, schema, keys, ["seq"], fan)

    def store(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("seq", F.lit(batch_id).cast("long")), batch_id)

    _drain(updates.writeStream.outputMode("update").foreachBatch(store), base)
    return log.latest(updates.sparkSession).drop("seq")


def coverage_counts(events: DataFrame, ts: str, dims: dict[str, Column]) -> DataFrame:
    """Rows of each day and how many of them carry each dimension."""
    return events.groupBy(F.window(ts, "1 day").alias("w")).agg(
        F.count("*").alias("n_total"), *[F.count_if(c).alias(d) for d, c in dims.items()]) \
        .select(F.to_date("w.start").alias("day"), "n_total", *dims)


def stream_coverage(stream: DataFrame, ts: str, dims: dict[str, Column], base: str, late: str = "6 hours",
                    fan: int = FAN) -> DataFrame:
    """Coverage counters refreshed with every batch: updates go to a log, where the newest count of a day
    is the current one."""
    return _current(coverage_counts(stream.withWatermark(ts, late), ts, dims), ["day"], f"{base}/updates", base, fan)


def stream_dedupe(stream: DataFrame, ts: str, keys: list[str], base: str, late: str = "1 day") -> DataFrame:
    """A row seen again within the watermark counts once."""
    out = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    _drain(out.writeStream.format("parquet").option("path", f"{base}/rows").outputMode("append"), base)
    return stream.sparkSession.read.schema(out.schema).parquet(f"{base}/rows")

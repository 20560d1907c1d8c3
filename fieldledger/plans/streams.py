"""Streams over the events table, drained to the end, next to their batch SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as S
from . import testbed as T
from .registry import query
from .units import cols


def events(spark, sf):
    schema = T.table(spark, sf, "events").schema
    stream = S.arriving(spark, sf, schema, "events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest_latest", f"""SELECT user_id, event_type, event_id, {cols('value')}, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def stream_ingest_latest(spark, sf):
    out = S.stream_ingest_latest(events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], S.workspace(spark, "latest"))
    return out.select("user_id", "event_type", "event_id", "value", "props")


@query("stream_daily_conditions", f"""
d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(value) AS high, min(value) AS low, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, event_type, n, {cols('high', 'low', 'mean')} FROM d""")
def stream_daily_conditions(spark, sf):
    return S.stream_daily_conditions(events(spark, sf), "ts", ["event_type"], S.workspace(spark, "daily"))


@query("stream_coverage", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_total, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE value > 10) AS large FROM events GROUP BY 1""")
def stream_coverage(spark, sf):
    dims = {"purchase": F.col("event_type") == "purchase", "large": F.col("value") > 10}
    return S.stream_coverage(events(spark, sf), "ts", dims, S.workspace(spark, "coverage"))


@query("stream_dedupe", f"SELECT DISTINCT event_id, user_id, event_type, {cols('value')} FROM events")
def stream_dedupe(spark, sf):
    """Every event is sent twice and must come out once."""
    rows = events(spark, sf)
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = S.stream_dedupe(doubled, "ts", ["event_id"], S.workspace(spark, "dedupe"))
    return out.select("event_id", "user_id", "event_type", "value")

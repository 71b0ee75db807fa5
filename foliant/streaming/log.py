"""The append-only log as a stream, and counters over request logs.

The original has no streaming; these are the forms that its log and its rate limits take on Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS
from ..operators.traces import LOGGED, LOGGED_ACTIONS

# Requests allowed in a window.
REGISTER_LIMIT, LOGIN_LIMIT = (5, "1 hour"), (10, "15 minutes")


def event_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Events of Parquet files as they arrive; an event seen twice within ``late`` counts once."""
    rows = spark.readStream.schema(SCHEMAS["activity_events"]).parquet(path)
    return rows.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["id"])


def trace_activity(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Traces made, changed or restored in each window of time, by person and kind."""
    own = events.where(F.col("entity_type").isin(LOGGED) & F.col("action").isin(LOGGED_ACTIONS))
    return own.groupBy(F.window("occurred_at", width), "user_id", "entity_type").agg(F.count("*").alias("n"))


def over_limit(requests: DataFrame, key: list[str | Column], limit: tuple[int, str], at: str = "at") -> DataFrame:
    """Windows in which a key made more requests than allowed; for batches and, with a watermark, for streams."""
    most, width = limit
    return requests.groupBy(F.window(at, width), *key).agg(F.count("*").alias("n")).where(F.col("n") > most)

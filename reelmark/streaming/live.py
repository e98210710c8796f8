"""The playback log as a stream: land new events, and sessions that close as the log moves on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reelmark import schemas
from reelmark.operators import history


def playback_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Normalised events of documents as they land."""
    documents = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    events = (
        documents.select(F.from_json("value", schemas.PLAYBACK_LOG, {"mode": "FAILFAST"}).alias("log"))
        .select(F.explode("log").alias("log_user", "events"))
        .select(F.explode("events").alias("event"))
        .select("event.*")
    )
    return history.normalize_tz(history.project_raw_event(events))


def live_sessions(events: DataFrame, gap_minutes: int = 15, late_minutes: int = 1440) -> DataFrame:
    """Sessions, each emitted once its gap has passed the watermark.

    `session_window` merges events exactly ``gap_minutes`` apart, as the batch rule does. Events later
    than ``late_minutes`` are not counted here; the nightly rebuild, which reads everything, is the
    record.
    """
    return (
        events.withWatermark("event_ts", f"{late_minutes} minutes")
        .groupBy("user_id", "item_id", F.session_window("event_ts", f"{gap_minutes} minutes"))
        .agg(
            F.min("event_ts").alias("session_start_timestamp"),
            F.max("event_ts").alias("session_end_timestamp"),
            F.sum("duration").alias("total_seconds_watched"),
            F.count(F.lit(1)).alias("session_count"),
        )
        .drop("session_window")
    )


def write_sessions(sessions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append closed sessions to Parquet exactly once; call ``start()`` on the result."""
    return (
        sessions.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )

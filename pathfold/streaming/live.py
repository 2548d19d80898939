"""Streaming forms: live tracks, upload status, once-only markers, new archive files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import haversine_m


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Cut each user's positions (user_id, ts, lon, lat) into activities at pauses.

    Works on a stream and on a table; on a stream a session is emitted once the watermark has
    passed its end.  Only counters and end points are kept per open session.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    at = F.struct("ts", "lon", "lat")
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.min("lon").alias("xmin"),
        F.min("lat").alias("ymin"),
        F.max("lon").alias("xmax"),
        F.max("lat").alias("ymax"),
        F.min(at).alias("_a"),
        F.max(at).alias("_b"),
    )
    return rows.select(
        "user_id",
        "started",
        "ended",
        "points",
        "xmin",
        "ymin",
        "xmax",
        "ymax",
        haversine_m("_a.lon", "_a.lat", "_b.lon", "_b.lat").alias("span_m"),
    )


def latest_status(changes: DataFrame) -> DataFrame:
    """Latest state per upload from a change feed (upload_id, status, n, at).

    ``n`` numbers the changes, so equal times still have one latest change.
    """
    return (
        changes.groupBy("upload_id")
        .agg(
            F.max_by(F.struct("status", "at"), F.struct("at", "n")).alias("s"),
            F.count(F.lit(1)).alias("changes"),
        )
        .select("upload_id", "s.status", "s.at", "changes")
    )


def notify_once(marks: DataFrame, key: str = "subject", late: str = "1 day") -> DataFrame:
    """First mark per key; on a stream the keys seen are kept for the watermark delay."""
    if marks.isStreaming:
        return marks.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
    return marks.dropDuplicates([key])


def watch_archives(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    compile_batch: Callable[[DataFrame, int], None],
    available_now: bool = True,
) -> StreamingQuery:
    """Hand newly arrived activity files (path, length, modificationTime) to a batch job."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length")
    )
    writer = files.writeStream.foreachBatch(compile_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

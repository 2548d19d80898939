"""Merge decoded device records that share a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite, semicircles_to_degrees, valid_coord
from .ranks import HOT_ROWS, dense_sequence

FIELDS = (
    "position_lat",
    "position_long",
    "altitude",
    "enhanced_altitude",
    "heart_rate",
    "cadence",
    "power",
)


def merge_records_by_timestamp(records: DataFrame) -> DataFrame:
    """One row per (file, timestamp): the last non-null value of each field wins.

    ``records`` is (file, n, ts, *FIELDS) with ``n`` the record number inside the file.
    Records without a timestamp stay apart; ``n`` of the result is the first record's.
    """
    n = F.col("n")
    return (
        records.groupBy("file", "ts", F.when(F.col("ts").isNull(), n).alias("_alone"))
        .agg(
            F.min("n").alias("n"),
            *[F.max_by(f, F.when(F.col(f).isNotNull(), n)).alias(f) for f in FIELDS],
        )
        .drop("_alone")
    )


def points_from_records(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Points of merged records with valid positions; ``activity_id`` is the file."""
    lon = semicircles_to_degrees("position_long")
    lat = semicircles_to_degrees("position_lat")
    placed = (
        merge_records_by_timestamp(records)
        .withColumns({"lon": lon, "lat": lat})
        .where(valid_coord("lon", "lat"))
        .withColumnRenamed("file", "activity_id")
    )
    return dense_sequence(placed, ["activity_id"], "n", hot_rows=hot_rows).select(
        "activity_id",
        "seq",
        "ts",
        "lon",
        "lat",
        finite(F.coalesce("enhanced_altitude", "altitude").cast("double")).alias("ele"),
        F.col("heart_rate").cast("double").alias("hr"),
        F.col("cadence").cast("double").alias("cadence"),
        F.col("power").cast("double").alias("power"),
    )

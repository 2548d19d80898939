"""Tracks derived from an ``events`` table: one activity per user and week.

All coordinates come from integer arithmetic on ``event_id`` and ``user_id``, with planted
GPS jumps (null island) and elevation spikes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import HOT_ROWS, dense_sequence
from ..session import use_utc

# Fixed values of the derivation.
SPORTS = ("Run", "Trail Run", "Ride", "Walk", "Kayaking", "Workout")
EPOCH = "2024-01-01"


def event_points(
    spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    use_utc(spark)
    keep = ["event_id", "user_id", "ts", "value", *extra]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*keep)
    week = F.floor(F.datediff("ts", F.lit(EPOCH).cast("date")) / 7).cast("long")
    numbered = dense_sequence(
        events.withColumn("week", week).withColumn(
            "activity_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("week"))
        ),
        ["activity_id"],
        "event_id",
        hot_rows=hot_rows,
    )
    e, u = F.col("event_id"), F.col("user_id")
    lost = e % 41 == 0
    start = F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    micros = start + F.col("week") * 7 * 86_400_000_000 + F.col("seq") * 10_000_000
    return numbered.select(
        "activity_id",
        "seq",
        F.timestamp_micros(micros).alias("ts"),
        F.when(lost, 0.0).otherwise(-105.0 + (u % 50) * 0.02 + (e % 97) * 0.00005).alias("lon"),
        F.when(lost, 0.0).otherwise(39.5 + (u % 40) * 0.02 + (e % 89) * 0.00005).alias("lat"),
        F.when(e % 53 == 0, None)
        .when(e % 37 == 0, 3500.0)
        .otherwise(1500.0 + F.col("value") / 10)
        .alias("ele"),
        F.when(e % 11 != 0, (100 + e % 80).cast("double")).alias("hr"),
        F.when(e % 13 != 0, (60 + e % 40).cast("double")).alias("cadence"),
        F.when(e % 3 == 0, (150 + e % 200).cast("double")).alias("power"),
        *extra,
    )


def event_records(points: DataFrame) -> DataFrame:
    """Archive-style metadata row of each derived activity, with gaps to exercise fallbacks."""
    parts = F.split("activity_id", "-")
    user, week = parts[0].cast("long"), parts[1].cast("long")
    n = F.col("_n")
    ids = points.select("activity_id").distinct()
    named = ids.withColumns({"_u": user, "_w": week}).withColumn("_n", F.col("_u") * 7 + F.col("_w"))
    u, w = F.col("_u"), F.col("_w")
    sport = F.element_at(F.array(*[F.lit(s) for s in SPORTS]), (u % 6 + 1).cast("int"))
    return named.select(
        "activity_id",
        F.when(n % 9 != 0, F.col("activity_id")).alias("source_activity_id"),
        F.concat(F.lit("activities/"), "activity_id", F.lit(".gpx")).alias("source_filename"),
        F.concat(F.lit("Activity "), "activity_id").alias("name"),
        sport.alias("sport_type"),
        F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (w * 7).cast("int")), "yyyy-MM-dd").alias(
            "start_text"
        ),
        ((n % 50) * 1000).cast("double").alias("distance_csv"),
        (n % 4000).cast("double").alias("elapsed_csv"),
        F.when(u % 5 == 0, None).when(u % 5 == 1, 0.0).otherwise((n % 3000).cast("double")).alias(
            "moving_csv"
        ),
        ((n % 7 - 1) * 10).cast("double").alias("gain_csv"),
        ((n % 5 - 1) * 10).cast("double").alias("loss_csv"),
        F.lit(100.0).alias("min_elevation_csv"),
        F.lit(200.0).alias("max_elevation_csv"),
    )

"""From track measures and archive records to activity rows and rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.geo import spatial_key
from ..schema import COMPILER_VERSION, SCALARS, SCHEMA_VERSION

SHORT_TRACK = "activity has fewer than two valid route points"


def describe_activities(summary: DataFrame, records: DataFrame) -> DataFrame:
    """Activity scalars of track summaries joined with their archive records.

    ``records`` carries the archive columns plus ``source_type`` and ``source_checksum``.
    """
    return activity_scalars(summary.join(records, "activity_id"))


def activity_scalars(joined: DataFrame) -> DataFrame:
    """Fallbacks to the archive row, and where each value came from."""
    c = F.col
    start = F.coalesce("track_start", sc.parse_activity_timestamp("start_text"))
    elapsed = (F.unix_micros("track_end") - F.unix_micros(c("_start"))) / 1e6
    on_track = c("track_distance_m") > 0
    has_ele = c("elevations") > 0
    begun = sc.start_or_epoch("_start")
    moving = c("moving_csv")
    rows = (
        joined.withColumn("_start", start)
        .withColumn("_elapsed", elapsed)
        .withColumns(
            {
                "schema_version": F.lit(SCHEMA_VERSION),
                "compiler_version": F.lit(COMPILER_VERSION),
                "start_time": begun,
                "end_time": c("track_end"),
                "start_year": F.year(begun).cast("long"),
                "start_month": F.month(begun).cast("long"),
                "original_start_time": sc.nonempty("start_text"),
                "source_url": sc.source_url("source_activity_id"),
                "distance_m": F.when(on_track, c("track_distance_m")).otherwise(
                    F.coalesce("distance_csv", F.lit(0.0))
                ),
                "elapsed_seconds": F.coalesce("_elapsed", "elapsed_csv"),
                "moving_seconds": F.when(moving != 0, moving).otherwise(c("_elapsed")),
                "elevation_gain_m": F.coalesce("track_gain_m", sc.clamp_negative("gain_csv")),
                "elevation_loss_m": F.coalesce("track_loss_m", sc.clamp_negative("loss_csv")),
                "min_elevation_m": F.coalesce("min_elevation", "min_elevation_csv"),
                "max_elevation_m": F.coalesce("max_elevation", "max_elevation_csv"),
                "clean_min_elevation_m": c("clean_min_elevation"),
                "clean_max_elevation_m": c("clean_max_elevation"),
                "spatial_order": spatial_key(
                    (c("xmin") + c("xmax")) / 2, (c("ymin") + c("ymax")) / 2
                ),
                "distance_source": F.when(on_track, "track").otherwise("csv"),
                "moving_time_source": F.when(moving.isNotNull(), "csv").otherwise("track"),
                "elevation_source": F.when(has_ele, "track").otherwise("csv"),
                "activity_family": sc.activity_family("sport_type"),
            }
        )
    )
    return rows.select(*SCALARS.fieldNames(), "activity_family")


def split_accepted(described_or_summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at least two points, fewer)."""
    enough = F.col("point_count") >= 2
    return described_or_summary.where(enough), described_or_summary.where(~enough)


def short_track_rejections(short: DataFrame, records: DataFrame) -> DataFrame:
    record = sc.reject_record(
        "source_filename", "source_activity_id", "parse", "ValueError", F.lit(SHORT_TRACK)
    )
    return (
        short.select("activity_id").join(records, "activity_id").select(record.alias("r")).select("r.*")
    )


def clean_view(activities: DataFrame) -> DataFrame:
    """Same columns with clean values in the ordinary names."""
    swaps = {
        n: F.coalesce(F.col(f"clean_{n}"), F.col(n))
        for n in (
            "distance_m",
            "elevation_gain_m",
            "elevation_loss_m",
            "min_elevation_m",
            "max_elevation_m",
        )
    }
    swaps["point_count"] = F.col("clean_point_count")
    swaps |= {n: F.col(f"clean_{n}") for n in ("xmin", "ymin", "xmax", "ymax")}
    return activities.withColumns(swaps)

"""Statistics of files, row groups and levels, and what a viewport would read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Bounds, bounds_intersect
from ..schema import BOUNDS, SCALAR_RULES


def _box() -> list[Column]:
    return [
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    ]


def row_group_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, box and vertex statistics per row group (``keys`` name file and group)."""
    vertex = [
        fn(c).alias(f"{c}_{name}")
        for c in ("vertex_count", "clean_vertex_count")
        if c in rows.columns
        for name, fn in (("sum", F.sum), ("min", F.min), ("max", F.max))
    ]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *_box(), *vertex)


def file_rollup(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Row groups rolled up to files (or files to levels)."""
    return groups.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("row_group_count"), *_box()
    )


def dataset_rollup(activities: DataFrame) -> DataFrame:
    """Activity count, bounds, first and last start (one row)."""
    return activities.agg(
        F.count(F.lit(1)).alias("activity_count"),
        *_box(),
        F.min("start_time").alias("first_activity"),
        F.max("start_time").alias("last_activity"),
    )


def source_counts(activities: DataFrame) -> DataFrame:
    return activities.groupBy("source_type").agg(F.count(F.lit(1)).alias("activities"))


def scan_metrics(
    files: DataFrame, row_groups: DataFrame, bounds: Bounds | None, kept_rows: Column | int = 0
) -> DataFrame:
    """Files, bytes, row groups and rows a viewport read touches (one row).

    ``files`` is (path, byte_size, xmin..ymax); ``row_groups`` is (path, row_group, row_count,
    xmin..ymax).  A row group counts as expected only inside a candidate file.
    """
    c = F.col
    boxed = files.withColumn("box", F.struct(*BOUNDS)).withColumn(
        "hit", bounds_intersect("box", bounds)
    )
    groups = row_groups.withColumn("gbox", F.struct(*BOUNDS)).withColumn(
        "ghit", bounds_intersect("gbox", bounds)
    )
    by_file = groups.groupBy("path").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if("ghit").alias("expected"),
        F.sum(F.when(c("ghit"), c("row_count")).otherwise(0)).alias("expected_rows"),
    )

    def hits(column: str) -> Column:
        return F.coalesce(F.sum(F.when(c("hit"), c(column)).otherwise(0)), F.lit(0)).cast("long")

    totals = boxed.join(by_file, "path", "left").agg(
        F.count_if("hit").alias("candidate_files"),
        F.count(F.lit(1)).alias("total_files"),
        hits("byte_size").alias("candidate_bytes"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).cast("long").alias("total_bytes"),
        hits("expected").alias("expected_row_groups"),
        hits("groups").alias("candidate_row_groups"),
        F.coalesce(F.sum("groups"), F.lit(0)).cast("long").alias("total_row_groups"),
        hits("expected_rows").alias("expected_rows"),
    )
    kept = F.lit(kept_rows) if isinstance(kept_rows, int) else kept_rows

    def percent(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))

    return totals.withColumn("kept_rows", kept).withColumns(
        {
            "avoided_bytes_percent": percent(
                c("total_bytes") - c("candidate_bytes"), c("total_bytes")
            ),
            "kept_percent": percent(c("kept_rows"), c("expected_rows")),
        }
    )


def manifest_vertex_estimate(row_groups: DataFrame, bounds: Bounds | None, clean: bool = False) -> DataFrame:
    """Vertices of the row groups a viewport touches, from statistics alone (one row)."""
    name = "clean_vertex_count_sum" if clean else "vertex_count_sum"
    return (
        row_groups.withColumn("gbox", F.struct(*BOUNDS))
        .where(bounds_intersect("gbox", bounds))
        .agg(F.coalesce(F.sum(name), F.lit(0)).alias("vertices"))
    )


def geometry_totals(segments: DataFrame) -> DataFrame:
    """Vertices, buffer bytes and activities of a fetched result (one row).

    ``segments`` is (activity_id, segment_no, points).  A vertex takes two doubles, a segment one
    start and one owner index, and each result ends with one closing start.
    """
    return segments.agg(
        F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("vertex_count"),
        F.count(F.lit(1)).alias("segment_count"),
        F.countDistinct("activity_id").alias("activity_count"),
    ).withColumn(
        "buffer_bytes", F.col("vertex_count") * 16 + F.col("segment_count") * 8 + F.lit(4)
    )


def rule_violations(rows: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(rule, violations) from one pass over the table."""
    rules = rules or SCALAR_RULES
    counted = rows.agg(
        *[
            F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name)
            for name, rule in rules.items()
        ]
    )
    return counted.unpivot([], list(rules), "rule", "violations")


def integrity(canonical: DataFrame) -> DataFrame:
    """Activities, distinct ids and rows whose clean flags, lengths or ends disagree (one row)."""
    kept = F.size(F.filter("track_points", lambda p: p["clean"]))
    return canonical.groupBy("activity_id").agg(
        F.first("clean_point_count").alias("clean_point_count"),
        F.first("point_count").alias("point_count"),
        F.first("dropped_jump_points").alias("j"),
        F.first("dropped_elevation_points").alias("e"),
        F.sum(kept).alias("kept"),
        F.sum(F.size("geometry")).alias("raw"),
        F.sum(F.size("geometry_clean")).alias("clean"),
        F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("rows"),
    ).agg(
        F.sum("rows").alias("activities"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(
            F.expr(
                "kept <> clean_point_count OR clean_point_count + j + e <> point_count"
                " OR raw <> point_count OR clean <> clean_point_count"
            )
        ).alias("mismatches"),
    )


def rejection_rate(rejections: DataFrame, activities: DataFrame) -> DataFrame:
    """Rejections, activities and their share (one row)."""
    bad = rejections.agg(F.count(F.lit(1)).alias("rejections"))
    good = activities.agg(F.count(F.lit(1)).alias("activities"))
    return bad.crossJoin(good).withColumn(  # one row by one row
        "rate",
        F.coalesce(
            F.try_divide(F.col("rejections"), F.col("rejections") + F.col("activities")), F.lit(0.0)
        ),
    )

"""Versioned schemas and value rules of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.6.0"
COMPILER_VERSION = "0.6.0"
RENDER_PYRAMID_VERSION = "5"
CLEAN_VERSIONS = ("1.2.0", "1.3.0", "1.4.0", "1.5.0", "1.6.0")

S, D, L, I, B, TS = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)

POINT = T.StructType(
    [
        T.StructField("sequence", I),
        T.StructField("timestamp", TS),
        T.StructField("longitude", D),
        T.StructField("latitude", D),
        T.StructField("elevation_m", D),
        T.StructField("heart_rate", D),
        T.StructField("cadence", D),
        T.StructField("power", D),
        T.StructField("clean", B),
    ]
)
LINE = T.ArrayType(T.ArrayType(D))

SCALARS = T.StructType(
    [
        T.StructField("activity_id", S),
        T.StructField("source_activity_id", S),
        T.StructField("source_filename", S),
        T.StructField("source_type", S),
        T.StructField("source_checksum", S),
        T.StructField("schema_version", S),
        T.StructField("compiler_version", S),
        T.StructField("name", S),
        T.StructField("sport_type", S),
        T.StructField("start_time", TS),
        T.StructField("end_time", TS),
        T.StructField("start_year", L),
        T.StructField("start_month", L),
        T.StructField("original_start_time", S),
        T.StructField("source_url", S),
        *[
            T.StructField(n, D)
            for n in (
                "distance_m",
                "elapsed_seconds",
                "moving_seconds",
                "elevation_gain_m",
                "elevation_loss_m",
                "min_elevation_m",
                "max_elevation_m",
            )
        ],
        *[
            T.StructField(n, L)
            for n in (
                "point_count",
                "clean_point_count",
                "dropped_jump_points",
                "dropped_elevation_points",
            )
        ],
        *[
            T.StructField(n, D)
            for n in (
                "clean_distance_m",
                "clean_elevation_gain_m",
                "clean_elevation_loss_m",
                "clean_min_elevation_m",
                "clean_max_elevation_m",
                "xmin",
                "ymin",
                "xmax",
                "ymax",
                "clean_xmin",
                "clean_ymin",
                "clean_xmax",
                "clean_ymax",
            )
        ],
        T.StructField("spatial_order", L),
        T.StructField("distance_source", S),
        T.StructField("moving_time_source", S),
        T.StructField("elevation_source", S),
    ]
)

# Vertex targets of the stored coarse lines.
LINE_TARGETS = (40, 100, 400, 2000)
GEOMETRY_COLUMNS = [
    f"geometry{c}{s}" for c in ("", "_clean") for s in ("", *[f"_lod{i}" for i in range(4)])
]

# ``part`` numbers the pieces of a track longer than one chunk; a usual track has part 0 only.
CANONICAL = T.StructType(
    [
        *SCALARS.fields,
        *[T.StructField(n, LINE, metadata={"crs": "OGC:CRS84", "encoding": "linestring"}) for n in GEOMETRY_COLUMNS],
        T.StructField("track_points", T.ArrayType(POINT)),
        T.StructField("part", L),
    ]
)
METADATA = T.StructType(
    [
        *SCALARS.fields,
        T.StructField("activity_family", S),
        T.StructField("canonical_path", S),
        T.StructField("canonical_row_group", I),
    ]
)
BOUNDS = ["xmin", "ymin", "xmax", "ymax"]
CLEAN_BOUNDS = [f"clean_{b}" for b in BOUNDS]
RENDER = T.StructType(
    [
        T.StructField("activity_id", S),
        *[T.StructField(n, D) for n in (*BOUNDS, *CLEAN_BOUNDS)],
        T.StructField("spatial_order", L),
        T.StructField("vertex_count", L),
        T.StructField("clean_vertex_count", L),
        T.StructField("geometry", LINE),
        T.StructField("geometry_clean", LINE),
        T.StructField("part", L),
    ]
)
REJECTION = T.StructType(
    [
        T.StructField("source_path", S),
        T.StructField("source_activity_id", S),
        T.StructField("stage", S),
        T.StructField("reason_code", S),
        T.StructField("message", S),
    ]
)

# Value rules as SQL; a row breaks a rule when the expression is not true.
SCALAR_RULES = {
    **{
        f"{n}_not_negative": f"{n} IS NULL OR {n} >= 0"
        for n in (
            "distance_m",
            "elapsed_seconds",
            "moving_seconds",
            "elevation_gain_m",
            "elevation_loss_m",
        )
    },
    "point_count_at_least_2": "point_count >= 2",
    "clean_point_count_at_least_2": "clean_point_count >= 2",
    "dropped_jump_points_not_negative": "dropped_jump_points >= 0",
    "dropped_elevation_points_not_negative": "dropped_elevation_points >= 0",
    **{f"{n}_range": f"{n} BETWEEN -180 AND 180" for n in ("xmin", "xmax")},
    **{f"{n}_range": f"{n} BETWEEN -90 AND 90" for n in ("ymin", "ymax")},
    "spatial_order_not_negative": "spatial_order >= 0",
    "start_year_range": "start_year BETWEEN 1970 AND 9999",
    "start_month_range": "start_month BETWEEN 1 AND 12",
    "counts_balance": "clean_point_count + dropped_jump_points + dropped_elevation_points"
    " = point_count",
    "required_text": "activity_id IS NOT NULL AND source_filename IS NOT NULL AND source_type IS"
    " NOT NULL AND source_checksum IS NOT NULL AND name IS NOT NULL AND sport_type IS NOT NULL",
    "required_sources": "distance_source IS NOT NULL AND moving_time_source IS NOT NULL AND"
    " elevation_source IS NOT NULL",
}

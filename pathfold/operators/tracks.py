"""Point-level track operators.

A single track may hold a large share of all points, so no operator partitions by
``activity_id`` alone.  Points carry a dense ``seq``; ``chunk = seq div CHUNK_POINTS`` bounds
every window group.  Neighbour lookups across a chunk border use a one-point *halo*
(``with_halo``); running totals and order-sensitive sums are finished on one summary row per
chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

CHUNK_POINTS = 65_536
GAP_M = 20_000.0
POINT_COLUMNS = ["activity_id", "seq", "ts", "lon", "lat", "ele", "hr", "cadence", "power"]

KEY = ["activity_id", "chunk"]


def _in_chunk() -> Window:
    return Window.partitionBy(*KEY).orderBy("seq")


def chunk_of(chunk_points: int = CHUNK_POINTS) -> Column:
    return F.expr(f"seq div {int(chunk_points)}")


def with_halo(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Assign chunks and copy each border point to the neighbouring chunk (``core`` = false)."""
    if chunk_points < 2:
        raise ValueError("a chunk holds at least two points")
    own, place = chunk_of(chunk_points), F.col("seq") % chunk_points
    homes = (
        F.when((place == 0) & (own > 0), F.array(own, own - 1))
        .when(place == chunk_points - 1, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    return points.withColumn("chunk", F.explode(homes)).withColumn("core", F.col("chunk") == own)


def _near(column: str, offset: int) -> Column:
    return (F.lag if offset < 0 else F.lead)(column, abs(offset)).over(_in_chunk())


def _seconds(a: Column, b: Column) -> Column:
    """Elapsed seconds; a non-positive or missing delta is unknown (null)."""
    s = (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return F.when(s > 0, s)


def _implausible(metres: Column, seconds: Column) -> Column:
    fast = F.when(seconds.isNull(), metres > 20_000).otherwise(metres / seconds > 80)
    return (metres > 1_000) & fast


def clean_track(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Flag isolated GPS jumps and elevation spikes.

    Each point is compared with its raw neighbours; the first and last point of a track
    always stay.  Adds ``chunk, leg_m, clean, dropped_jump, dropped_elevation``; the result is
    partitioned by (activity_id, chunk).
    """
    around = with_halo(points, chunk_points).withColumns(
        {
            f"_{side}_{c}": _near(c, step)
            for side, step in (("p", -1), ("n", 1))
            for c in ("lon", "lat", "ts", "ele")
        }
    )
    c = F.col
    # Named before use, so that each leg and delta is computed once.
    measured = around.withColumns(
        {
            "_leg_in": haversine_m("_p_lon", "_p_lat", "lon", "lat"),
            "_leg_out": haversine_m("lon", "lat", "_n_lon", "_n_lat"),
            "_leg_past": haversine_m("_p_lon", "_p_lat", "_n_lon", "_n_lat"),
            "_s_in": _seconds(c("_p_ts"), c("ts")),
            "_s_out": _seconds(c("ts"), c("_n_ts")),
            "_s_past": _seconds(c("_p_ts"), c("_n_ts")),
            "_rise": c("ele") - c("_p_ele"),
            "_drop": c("ele") - c("_n_ele"),
        }
    )
    inner = c("_p_lon").isNotNull() & c("_n_lon").isNotNull()

    def steep(delta: str, seconds: str) -> Column:
        return F.abs(delta) > F.coalesce(c(seconds) * 10.0, F.lit(500.0))

    spike = (
        (F.abs("_rise") > 150)
        & (F.abs("_drop") > 150)
        & (c("_rise") * c("_drop") > 0)
        & (F.abs(c("_n_ele") - c("_p_ele")) < 100)
        & steep("_rise", "_s_in")
        & steep("_drop", "_s_out")
    )
    jump = (
        inner
        & _implausible(c("_leg_in"), c("_s_in"))
        & _implausible(c("_leg_out"), c("_s_out"))
        & ~_implausible(c("_leg_past"), c("_s_past"))
    )
    flagged = (
        measured.where("core")
        .withColumns({"leg_m": F.coalesce("_leg_in", F.lit(0.0)), "dropped_jump": jump})
        .withColumn(
            "dropped_elevation",
            inner & ~c("dropped_jump") & F.coalesce(spike, F.lit(False)),
        )
    )
    return flagged.select(
        *points.columns,
        "chunk",
        "leg_m",
        (~c("dropped_jump") & ~c("dropped_elevation")).alias("clean"),
        "dropped_jump",
        "dropped_elevation",
    )


def running_total(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` along each track.

    ``df`` has (activity_id, chunk, seq).  The sum runs inside a chunk; chunks after the first
    add the total of the chunks before them, from one row per chunk.
    """
    upto = _in_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("activity_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    valued = df.withColumn("_v", value)
    starts = (
        valued.groupBy(*KEY)
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_start", F.sum("_t").over(before))
        .where("chunk > 0")
        .drop("_t")
    )
    inside = valued.withColumn("_w", F.sum("_v").over(upto))
    total = F.col("_w") + F.coalesce(F.col("_start"), F.lit(0))
    return inside.join(starts, KEY, "left").withColumn(name, total).drop("_v", "_w", "_start")


def clean_points(flagged: DataFrame) -> DataFrame:
    """Kept points only, renumbered densely."""
    numbered = running_total(flagged, F.col("clean").cast("long"), "_kept")
    return (
        numbered.where("clean")
        .withColumn("seq", F.col("_kept") - 1)
        .drop("_kept", "chunk", "leg_m", "clean", "dropped_jump", "dropped_elevation")
    )


def with_legs(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Metres from the previous point (0 for the first); adds ``chunk, leg_m``."""
    leg = haversine_m(_near("lon", -1), _near("lat", -1), F.col("lon"), F.col("lat"))
    return (
        with_halo(points, chunk_points)
        .withColumn("leg_m", F.coalesce(leg, F.lit(0.0)))
        .where("core")
        .drop("core")
    )


def cumulative_distance(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    return running_total(with_legs(points, chunk_points), F.col("leg_m"), "distance_m")


def elevation_profile(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Samples with a finite elevation; distance accumulates over every point."""
    ele = F.col("ele")
    return (
        cumulative_distance(points, chunk_points)
        .where(ele.isNotNull() & ~F.isnan(ele) & (F.abs(ele) != float("inf")))
        .select("activity_id", "seq", "distance_m", "ele", "lon", "lat")
    )


def split_segments(
    points: DataFrame, gap_m: float = GAP_M, chunk_points: int = CHUNK_POINTS
) -> DataFrame:
    """Number the pieces of a track between legs longer than ``gap_m``: adds ``segment_no``."""
    gap = (F.col("leg_m") > gap_m).cast("long")
    return running_total(with_legs(points, chunk_points), gap, "segment_no")


def segment_table(segmented: DataFrame, min_points: int = 2) -> DataFrame:
    """One row per piece; ``min_points=2`` drops one-point pieces, 1 keeps them."""
    return (
        segmented.groupBy("activity_id", "segment_no")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.min("lon").alias("xmin"),
            F.min("lat").alias("ymin"),
            F.max("lon").alias("xmax"),
            F.max("lat").alias("ymax"),
        )
        .where(F.col("points") >= min_points)
    )


def edges(points: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Consecutive vertex pairs (activity_id, seq, x0, y0, x1, y1)."""
    return (
        with_halo(points.select("activity_id", "seq", "lon", "lat"), chunk_points)
        .withColumns({"x1": _near("lon", 1), "y1": _near("lat", 1)})
        .where("core AND x1 IS NOT NULL")
        .select("activity_id", "seq", F.col("lon").alias("x0"), F.col("lat").alias("y0"), "x1", "y1")
    )


def chunk_sums(flagged: DataFrame, *more: Column) -> DataFrame:
    """One row per chunk: plain aggregates plus the end points needed to link chunks.

    ``more`` adds aggregates to the same pass.
    """
    before = _in_chunk().rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    position = F.struct("lon", "lat")
    kept = flagged.withColumns(
        {
            "_e": F.last("ele", ignorenulls=True).over(before),
            "_cp": F.last(F.when(c("clean"), position), ignorenulls=True).over(before),
            "_ce": F.last(F.when(c("clean"), c("ele")), ignorenulls=True).over(before),
        }
    )
    clean, has_ele = c("clean"), c("ele").isNotNull()
    kept = kept.withColumns(
        {
            "_leg": F.when(clean, haversine_m(c("_cp.lon"), c("_cp.lat"), c("lon"), c("lat"))),
            "_up": c("ele") - c("_e"),
            "_cup": F.when(clean, c("ele") - c("_ce")),
            "_cele": F.when(clean, c("ele")),
        }
    )
    up, clean_up = c("_up"), c("_cup")

    def positive(x: Column) -> Column:
        return F.when(x > 0, x)

    def ends(value: Column, when: Column, name: str) -> list[Column]:
        at = F.when(when, c("seq"))
        return [F.min_by(value, at).alias(f"first_{name}"), F.max_by(value, at).alias(f"last_{name}")]

    return kept.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.count_if(clean).alias("clean_point_count"),
        F.count_if("dropped_jump").alias("dropped_jump_points"),
        F.count_if("dropped_elevation").alias("dropped_elevation_points"),
        F.min("ts").alias("track_start"),
        F.max("ts").alias("track_end"),
        F.sum("leg_m").alias("distance"),
        F.sum("_leg").alias("clean_distance"),
        F.count("ele").alias("elevations"),
        F.count("_cele").alias("clean_elevations"),
        F.sum(positive(up)).alias("gain"),
        F.sum(positive(-up)).alias("loss"),
        F.sum(positive(clean_up)).alias("clean_gain"),
        F.sum(positive(-clean_up)).alias("clean_loss"),
        F.min("ele").alias("min_elevation"),
        F.max("ele").alias("max_elevation"),
        F.min("_cele").alias("clean_min_elevation"),
        F.max("_cele").alias("clean_max_elevation"),
        *(
            fn(F.when(clean, c(axis)) if prefix else c(axis)).alias(f"{prefix}{out}")
            for prefix in ("", "clean_")
            for axis, fn, out in (
                ("lon", F.min, "xmin"),
                ("lat", F.min, "ymin"),
                ("lon", F.max, "xmax"),
                ("lat", F.max, "ymax"),
            )
        ),
        *ends(c("ele"), has_ele, "ele"),
        *ends(position, clean, "clean_pos"),
        *ends(c("ele"), clean & has_ele, "clean_ele"),
        *more,
    )


def track_summary(flagged: DataFrame) -> DataFrame:
    """Per-activity raw and clean measures from ``clean_track`` output."""
    return link_chunks(chunk_sums(flagged))


def link_chunks(sums: DataFrame) -> DataFrame:
    """Chunk rows to activity rows.

    Gain, loss and clean distance depend on the previous kept value, so each chunk reports its
    first and last such value and the steps between chunks are added here.
    """
    c = F.col
    before = Window.partitionBy("activity_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )

    def previous(name: str) -> Column:
        return F.last(name, ignorenulls=True).over(before)

    linked = sums.withColumns(
        {
            "_step": c("first_ele") - previous("last_ele"),
            "_clean_step": c("first_clean_ele") - previous("last_clean_ele"),
            "_prev_pos": previous("last_clean_pos"),
        }
    )
    bridge = haversine_m(
        c("_prev_pos.lon"), c("_prev_pos.lat"), c("first_clean_pos.lon"), c("first_clean_pos.lat")
    )

    def total(column: str, link: Column) -> Column:
        return F.sum(F.coalesce(c(column), F.lit(0.0)) + F.coalesce(link, F.lit(0.0)))

    def up(x: Column) -> Column:
        return F.when(x > 0, x)

    enough, clean_enough = F.sum("elevations") > 1, F.sum("clean_elevations") > 1
    counts = (
        "point_count",
        "clean_point_count",
        "dropped_jump_points",
        "dropped_elevation_points",
    )
    lows = ("min_elevation", "clean_min_elevation", "xmin", "ymin", "clean_xmin", "clean_ymin")
    highs = ("max_elevation", "clean_max_elevation", "xmax", "ymax", "clean_xmax", "clean_ymax")
    return linked.groupBy("activity_id").agg(
        F.min("track_start").alias("track_start"),
        F.max("track_end").alias("track_end"),
        *(F.sum(n).alias(n) for n in counts),
        F.sum("elevations").alias("elevations"),
        F.sum("distance").alias("track_distance_m"),
        total("clean_distance", bridge).alias("clean_distance_m"),
        F.when(enough, total("gain", up(c("_step")))).alias("track_gain_m"),
        F.when(enough, total("loss", up(-c("_step")))).alias("track_loss_m"),
        F.when(clean_enough, total("clean_gain", up(c("_clean_step")))).alias(
            "clean_elevation_gain_m"
        ),
        F.when(clean_enough, total("clean_loss", up(-c("_clean_step")))).alias(
            "clean_elevation_loss_m"
        ),
        *(F.min(n).alias(n) for n in lows),
        *(F.max(n).alias(n) for n in highs),
    )


def nested_points() -> Column:
    """Aggregate: the points of a chunk as an ordered array of storage structs."""
    return F.sort_array(
        F.collect_list(
            F.struct(
                F.col("seq").cast("int").alias("sequence"),
                F.col("ts").alias("timestamp"),
                F.col("lon").alias("longitude"),
                F.col("lat").alias("latitude"),
                F.col("ele").cast("double").alias("elevation_m"),
                F.col("hr").cast("double").alias("heart_rate"),
                F.col("cadence").cast("double").alias("cadence"),
                F.col("power").cast("double").alias("power"),
                "clean",
            )
        )
    )


def with_lines(parts: DataFrame) -> DataFrame:
    """Add the raw and the clean line of ``track_points``."""

    def line(points: Column) -> Column:
        return F.transform(points, lambda p: F.array(p["longitude"], p["latitude"]))

    kept = F.filter("track_points", lambda p: p["clean"])
    return parts.withColumns(
        {"geometry": line(F.col("track_points")), "geometry_clean": line(kept)}
    )


def track_parts(flagged: DataFrame) -> DataFrame:
    """Nested storage form: one row per (activity_id, part) of at most one chunk of points."""
    return with_lines(
        flagged.groupBy("activity_id", F.col("chunk").alias("part")).agg(
            nested_points().alias("track_points")
        )
    )


def points_from_parts(parts: DataFrame) -> DataFrame:
    """Back to the long form, with the stored ``clean`` flag; no shuffle."""
    p = F.col("p")
    return parts.select("activity_id", F.explode("track_points").alias("p")).select(
        "activity_id",
        p["sequence"].cast("long").alias("seq"),
        p["timestamp"].alias("ts"),
        p["longitude"].alias("lon"),
        p["latitude"].alias("lat"),
        p["elevation_m"].alias("ele"),
        p["heart_rate"].alias("hr"),
        p["cadence"].alias("cadence"),
        p["power"].alias("power"),
        p["clean"].alias("clean"),
    )

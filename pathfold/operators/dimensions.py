"""Query dimensions: long values, ordered steps, frames and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import dimension_color
from .ranks import global_rank
from .selection import dimension_columns

SALTS = 32
ORDER = ["dimension", "number", "value"]


def dimension_values(selected: DataFrame) -> DataFrame:
    """Wide selection to long (activity_id, dimension, kind, value, number).

    ``number`` is set for numeric dimensions, ``value`` is the text form.
    """
    kinds = dimension_columns(selected)
    if not kinds:
        raise ValueError("the selection has no dimension columns")
    cells = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.lit(kind).alias("kind"),
            F.col(name).cast("string").alias("value"),
            (F.col(name).cast("double") if kind == "numeric" else F.lit(None).cast("double")).alias(
                "number"
            ),
        )
        for name, kind in kinds.items()
    ]
    return selected.select("activity_id", F.explode(F.array(*cells)).alias("c")).select(
        "activity_id", "c.*"
    )


def dimension_steps(values: DataFrame) -> DataFrame:
    """Distinct steps of each dimension with their 0-based index in value order."""
    steps = values.where("value IS NOT NULL").select("kind", *ORDER).distinct()
    ranked = global_rank(steps, ORDER, "_r")
    first = ranked.groupBy("dimension").agg(F.min("_r").alias("_first"))
    return (
        ranked.join(F.broadcast(first), "dimension")  # one row per column of the selection
        .withColumn("step", F.col("_r") - F.col("_first"))
        .drop("_r", "_first")
    )


def dimension_profile(values: DataFrame) -> DataFrame:
    """Per dimension: kind, number of steps, numeric domain."""
    return (
        values.where("value IS NOT NULL")
        .groupBy("dimension", "kind")
        .agg(
            F.countDistinct("value").alias("steps"),
            F.min("number").alias("low"),
            F.max("number").alias("high"),
        )
    )


def with_steps(values: DataFrame, steps: DataFrame) -> DataFrame:
    """Value rows with their step index; a null value keeps a null step.

    Null values take no part in the join, and each step stands in ``SALTS`` copies so that the rows
    of a frequent value are dealt over as many tasks.
    """
    present = values.where("value IS NOT NULL").withColumn(
        "_salt", F.pmod(F.xxhash64("activity_id"), F.lit(SALTS)).cast("int")
    )
    copies = steps.select(
        "dimension", "value", "step", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    found = present.join(copies, ["dimension", "value", "_salt"], "left").drop("_salt")
    return found.unionByName(values.where("value IS NULL"), allowMissingColumns=True)


def frame_visible(step, current: int, mode: str = "cumulative", window: int = 1) -> Column:
    """Whether a step shows in the frame ``current``; a null step never does."""
    step = F.col(step) if isinstance(step, str) else step
    first = 0 if mode == "cumulative" else max(0, current - window + 1)
    return F.coalesce(step.between(first, current), F.lit(False))


def clamp_step(step: int, steps: int) -> int:
    return max(0, min(steps - 1, step)) if steps else 0


def frame_labels(steps: DataFrame) -> DataFrame:
    return steps.select(
        "dimension", "step", F.concat("dimension", F.lit(" = "), "value").alias("label")
    )


def dimension_colors(
    stepped: DataFrame, profile: DataFrame, kind: str, palette: str = "viridis"
) -> DataFrame:
    """Colour of every value row of one kind; ``profile`` has one row per dimension."""
    side = profile.select("dimension", "low", "high", F.col("steps").alias("n_steps"))
    return (
        stepped.where(F.col("kind") == kind)
        .join(F.broadcast(side), "dimension")  # one row per column of the selection
        .withColumn(
            "color",
            F.when(
                F.col("value").isNotNull(),
                dimension_color("number", "step", kind, "low", "high", "n_steps", palette),
            ),
        )
        .drop("low", "high", "n_steps")
    )


def dimension_sizes(values: DataFrame) -> DataFrame:
    """(dimension, steps) of every dimension, also of one without any value."""
    return values.groupBy("dimension").agg(F.countDistinct("value").alias("steps"))


def reconcile_encodings(encodings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fit saved views to the dimensions the selection has now (dimension, steps).

    A lost animate or colour dimension is blanked; the step is clamped to the dimension's steps, and
    only a dimension of two steps or more plays.
    """
    side = F.broadcast(sizes)  # one row per column of the selection
    moving = side.select(F.col("dimension").alias("animate_by"), F.col("steps").alias("_moving"))
    coloured = side.select(F.col("dimension").alias("color_by"), F.lit(True).alias("_coloured"))
    joined = encodings.join(moving, "animate_by", "left").join(coloured, "color_by", "left")
    kept = F.col("_moving").isNotNull()
    last = F.greatest(F.col("_moving") - 1, F.lit(0))
    step = F.greatest(F.lit(0), F.least(last, F.col("animation_step")))
    return joined.withColumns(
        {
            "animation_step": F.when(kept, F.coalesce(step, F.lit(0))).otherwise(0),
            "playing": kept & (F.col("_moving") > 1) & F.coalesce("playing", F.lit(False)),
            "color_by": F.when(F.col("_coloured"), F.col("color_by")).otherwise(""),
            "animate_by": F.when(kept, F.col("animate_by")).otherwise(""),
        }
    ).select(*encodings.columns)


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & (F.abs(name) < float("inf")) & ~F.isnan(name)


def normalize_encodings(encodings: DataFrame) -> DataFrame:
    """Clamp saved animation settings; missing and non-finite ones fall back to the defaults.

    ``loop`` and ``show_map_controls`` are added with their defaults where the rows lack them.
    """
    c = F.col
    for name in ("loop", "show_map_controls"):
        if name not in encodings.columns:
            encodings = encodings.withColumn(name, F.lit(None).cast("boolean"))
    window = F.when(_finite("window_size"), F.greatest(F.lit(1.0), F.floor(c("window_size") + 0.5))).otherwise(1.0)
    speed = F.when(
        _finite("playback_speed"), F.least(F.lit(240.0), F.greatest(F.lit(0.1), c("playback_speed")))
    ).otherwise(2.0)
    custom = F.filter(
        F.split(F.regexp_replace("palette", "^custom:", ""), ","),
        lambda s: s.rlike("^#[0-9a-fA-F]{6}$"),
    )
    known = c("palette").isin("sunset", "viridis", "fire", "ice") | (
        c("palette").startswith("custom:") & (F.size(custom) > 1)
    )
    return encodings.withColumns(
        {
            "window_size": window.cast("long"),
            "playback_speed": speed,
            "palette": F.when(known, c("palette")).otherwise("viridis"),
            "mode": F.when(c("mode") == "windowed", "windowed").otherwise("cumulative"),
            "animate_by": F.coalesce("animate_by", F.lit("")),
            "color_by": F.coalesce("color_by", F.lit("")),
            "loop": F.coalesce("loop", F.lit(True)),
            "show_map_controls": F.coalesce("show_map_controls", F.lit(False)),
        }
    )

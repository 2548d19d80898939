"""Spatial file layout: sort-tile-recursive stripes and byte-bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import mercator_x, mercator_y
from .ranks import global_rank

GROUP_BYTES = 4 * 1024 * 1024
FILE_BYTES = 1024 * 1024 * 1024
ROW_OVERHEAD_BYTES = 120  # scalars and list offsets of one render row


def render_row_bytes(vertices="vertex_count", clean_vertices="clean_vertex_count") -> Column:
    """Uncompressed size of a render row: two doubles per vertex plus a constant."""
    return ((F.col(vertices) + F.col(clean_vertices)) * 16 + ROW_OVERHEAD_BYTES).cast("long")


def box_centres(rows: DataFrame) -> DataFrame:
    """Projected centre and box of each row's bounds."""
    left, right = mercator_x("xmin"), mercator_x("xmax")
    low, high = mercator_y("ymin"), mercator_y("ymax")
    return rows.withColumns(
        {
            "cx": (left + right) / 2,
            "cy": (low + high) / 2,
            "_l": left,
            "_r": right,
            "_b": low,
            "_t": high,
        }
    )


def stripe_sizes(sized: DataFrame, target_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows per vertical stripe for each level, from one statistics row per level."""
    c = F.col
    stats = sized.groupBy("lod").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("total"),
        (F.max("_r") - F.min("_l")).alias("w"),
        (F.max("_t") - F.min("_b")).alias("h"),
    )
    rows = F.greatest(F.lit(1), F.floor(F.lit(target_bytes) / F.greatest(F.lit(1.0), c("total") / c("n"))))
    leaves = F.greatest(F.lit(1), F.ceil(c("n") / c("_rows")))
    aspect = F.greatest(F.lit(1.0), c("w")) / F.greatest(F.lit(1.0), c("h"))
    slices = F.greatest(F.lit(1), F.least(c("_leaves"), F.ceil(F.sqrt(c("_leaves") * aspect))))
    return (
        stats.withColumn("_rows", rows)
        .withColumn("_leaves", leaves)
        .withColumn("_slices", slices)
        .select("lod", F.ceil(c("n") / c("_slices")).cast("long").alias("slice_rows"))
    )


def str_order(sized: DataFrame, target_bytes: int = GROUP_BYTES) -> DataFrame:
    """Stripe and position of every row.

    ``sized`` is (activity_id, part, lod, bytes, xmin..ymax).  The x order is the same for all
    levels, so it is ranked once over the rows of one level; each level then cuts its own
    stripes and orders them by y.
    """
    c = F.col
    centred = box_centres(sized)
    per_level = stripe_sizes(centred, target_bytes)
    key = ["activity_id", "part"]
    one = centred.select(*key, "cx", "cy").distinct()
    ranked = global_rank(one, ["cx", "cy", "activity_id", "part"], "x_rank").select(*key, "x_rank")
    striped = (
        centred.join(ranked, key)
        .join(F.broadcast(per_level), "lod")  # one row per level
        .withColumn("stripe", F.floor(c("x_rank") / c("slice_rows")).cast("long"))
        .drop("_l", "_r", "_b", "_t", "x_rank", "slice_rows")
    )
    # Ranked over range partitions: a stripe may hold any share of the rows.
    placed = global_rank(striped, ["lod", "stripe", "cy", "cx", "activity_id", "part"], "_rank")
    first = placed.groupBy("lod", "stripe").agg(F.min("_rank").alias("_first"))
    return placed.join(first, ["lod", "stripe"]).withColumn("position", c("_rank") - c("_first")).drop("_rank", "_first")


RUN_ROWS = 1 << 16


def greedy_groups(sizes: np.ndarray, target: int) -> np.ndarray:
    """Group number of each row: fill up to ``target``, an oversize row stands alone."""
    ends = np.cumsum(sizes)
    groups = np.empty(len(sizes), dtype=np.int64)
    start = number = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + target, side="right")))
        groups[start:stop] = number
        start, number = stop, number + 1
    return groups


def byte_groups(ordered: DataFrame, target_bytes: int = GROUP_BYTES) -> DataFrame:
    """Add ``group_no``, rising inside each (lod, stripe); only narrow columns enter Python.

    A stripe is packed in runs of ``RUN_ROWS`` positions, so a group ends at the end of a run.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        return rows.assign(group_no=greedy_groups(rows["bytes"].to_numpy(), target_bytes))

    run = F.floor(F.col("position") / RUN_ROWS)
    narrow = ordered.select("lod", "stripe", run.alias("run"), "position", "bytes")
    packed = narrow.groupBy("lod", "stripe", "run").applyInPandas(
        pack, "lod int, stripe long, run long, position long, bytes long, group_no long"
    )
    numbered = packed.select("lod", "stripe", "position", (F.col("run") * RUN_ROWS + F.col("group_no")).alias("group_no"))
    return ordered.join(numbered, ["lod", "stripe", "position"])


def str_layout(sized: DataFrame, target_bytes: int = GROUP_BYTES) -> DataFrame:
    return byte_groups(str_order(sized, target_bytes), target_bytes)

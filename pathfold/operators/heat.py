"""Heat: how much other routes overlap a route inside a viewport."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite, world_x, world_y

# A viewport has a fixed number of pixels; this many cells of it are broadcast.
BROADCAST_ROWS = 200_000


def visible_cells(
    vertices: DataFrame,
    longitude: float,
    latitude: float,
    zoom: float,
    width: float,
    height: float,
    cell_px: float = 8.0,
    clip: bool = True,
) -> DataFrame:
    """Pixel cell (cx, cy) of every vertex within half the viewport plus one cell."""
    size = 512.0 * 2.0**zoom
    placed = vertices.withColumns(
        {"_x": world_x(finite("lon"), size), "_y": world_y(finite("lat"), size)}
    ).where("_x IS NOT NULL AND _y IS NOT NULL")
    if clip:
        phi = math.radians(max(-85.051129, min(85.051129, latitude)))
        at_x = (longitude + 180) / 360 * size
        at_y = (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * size
        dx, dy = F.abs(F.col("_x") - at_x), F.abs(F.col("_y") - at_y)
        placed = placed.where(
            (F.least(dx, F.lit(size) - dx) <= width / 2 + cell_px) & (dy <= height / 2 + cell_px)
        )
    return placed.select(
        "activity_id",
        F.floor(F.col("_x") / cell_px).cast("long").alias("cx"),
        F.floor(F.col("_y") / cell_px).cast("long").alias("cy"),
    )


def _neighbourhood(cells: DataFrame) -> DataFrame:
    """Send each cell row to its 3x3 neighbourhood (nx, ny); ``own`` marks the cell itself."""
    steps = F.array(
        *[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    )
    return cells.withColumn("_s", F.explode(steps)).select(
        *[c for c in cells.columns if c not in ("cx", "cy")],
        (F.col("cx") + F.col("_s.x")).alias("nx"),
        (F.col("cy") + F.col("_s.y")).alias("ny"),
        ((F.col("_s.x") == 0) & (F.col("_s.y") == 0)).alias("own"),
    )


def cell_counts(cells: DataFrame) -> DataFrame:
    """Vertices per (activity, cell); partial aggregation absorbs a dense cell."""
    return cells.groupBy("activity_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def heat_scores(
    counts: DataFrame, max_cells: int | None = None
) -> DataFrame:
    """(activity_id, score, visible_vertices) from ``cell_counts``.

    score = sum over own cells of own * max(0, vertices of other routes in the 3x3
    neighbourhood) / visible vertices.  ``max_cells`` is the number of cells a clipped viewport
    can hold; when it is small the per-cell totals are broadcast, else the join is left to AQE.
    """
    totals = counts.groupBy("cx", "cy").agg(F.sum("n").alias("n"))
    around = (
        _neighbourhood(totals)
        .groupBy("nx", "ny")
        .agg(F.sum("n").alias("all_n"), F.max("own").alias("occupied"))
        .where("occupied")
        .drop("occupied")
    )
    own = (
        _neighbourhood(counts)
        .groupBy("activity_id", "nx", "ny")
        .agg(
            F.sum("n").alias("own_around"),
            F.sum(F.when(F.col("own"), F.col("n"))).alias("own_n"),
        )
        .where("own_n IS NOT NULL")
    )
    if max_cells is not None and max_cells <= BROADCAST_ROWS:
        around = F.broadcast(around)
    others = F.col("all_n") - F.col("own_around")
    return (
        own.join(around, ["nx", "ny"])
        .groupBy("activity_id")
        .agg(
            F.sum(F.col("own_n") * F.when(others > 0, others).otherwise(0)).alias("_overlap"),
            F.sum("own_n").alias("visible_vertices"),
        )
        .select(
            "activity_id",
            (F.col("_overlap") / F.col("visible_vertices")).alias("score"),
            "visible_vertices",
        )
    )


def viewport_cells(width: float, height: float, cell_px: float = 8.0) -> int:
    """Upper bound of the cells in a clipped viewport."""
    return int((width / cell_px + 4) * (height / cell_px + 4))


def heat(
    vertices: DataFrame,
    longitude: float,
    latitude: float,
    zoom: float,
    width: float,
    height: float,
    cell_px: float = 8.0,
    clip: bool = True,
    exclude: str | None = None,
    isolate: str | None = None,
) -> DataFrame:
    if exclude is not None:
        vertices = vertices.where(F.col("activity_id") != exclude)
    if isolate is not None:
        vertices = vertices.where(F.col("activity_id") == isolate)
    cells = visible_cells(vertices, longitude, latitude, zoom, width, height, cell_px, clip)
    bound = viewport_cells(width, height, cell_px) if clip else None
    return heat_scores(cell_counts(cells), bound)


def heat_totals(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Scale maximum, vertices and cells behind the scores (one row)."""
    top = scores.agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.sum("visible_vertices"), F.lit(0)).alias("source_vertices"),
    )
    cells = counts.select("cx", "cy").distinct().agg(F.count(F.lit(1)).alias("cell_count"))
    return top.crossJoin(cells)  # one row by one row


def dense_cell(activities: DataFrame, width: float = 0.02) -> DataFrame:
    """Cell of bounding-box centres with the most activities; ties to the lowest cell."""

    def cell(low: str, high: str) -> Column:
        return F.floor((F.col(low) + F.col(high)) / 2 / width).cast("long")

    counted = activities.groupBy(
        cell("xmin", "xmax").alias("cx"), cell("ymin", "ymax").alias("cy")
    ).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(
        F.struct("cx", "cy", "n"), F.struct("n", (-F.col("cx")).alias("a"), (-F.col("cy")).alias("b"))
    )
    return counted.agg(best.alias("b")).select(
        "b.cx",
        "b.cy",
        "b.n",
        (F.col("b.cx") * width).alias("west"),
        (F.col("b.cy") * width).alias("south"),
        ((F.col("b.cx") + 1) * width).alias("east"),
        ((F.col("b.cy") + 1) * width).alias("north"),
    )

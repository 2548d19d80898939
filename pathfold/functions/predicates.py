"""Viewport predicates: plain comparisons, so they push down to Parquet statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = Sequence[float]


def check_bounds(bounds: Bounds) -> tuple[float, float, float, float]:
    values = tuple(float(v) for v in bounds)
    if len(values) != 4 or not all(math.isfinite(v) for v in values):
        raise ValueError("viewport bounds must be four finite numbers")
    return values


def viewport_intersects(bounds: Bounds | None, clean: bool = False) -> Column:
    """Bounding box touches the viewport; west > east means it crosses the antimeridian."""
    if bounds is None:
        return F.lit(True)
    west, south, east, north = check_bounds(bounds)
    p = "clean_" if clean else ""
    right, left = F.col(f"{p}xmax") >= west, F.col(f"{p}xmin") <= east
    across = (right & left) if west <= east else (right | left)
    return across & (F.col(f"{p}ymax") >= south) & (F.col(f"{p}ymin") <= north)


def viewport_contains(bounds: Bounds | None, clean: bool = False) -> Column:
    """Bounding box lies wholly in the viewport."""
    if bounds is None:
        return F.lit(True)
    west, south, east, north = check_bounds(bounds)
    p = "clean_" if clean else ""
    right, left = F.col(f"{p}xmin") >= west, F.col(f"{p}xmax") <= east
    across = (right & left) if west <= east else (right | left)
    return across & (F.col(f"{p}ymin") >= south) & (F.col(f"{p}ymax") <= north)


def bounds_intersect(a: str, bounds: Bounds | None) -> Column:
    """Struct column ``a`` (xmin, ymin, xmax, ymax) against a viewport; a null box is kept."""
    if bounds is None:
        return F.lit(True)
    west, south, east, north = check_bounds(bounds)
    box = F.col(a)
    right, left = box["xmax"] >= west, box["xmin"] <= east
    across = (right & left) if west <= east else (right | left)
    return box.isNull() | (across & (box["ymax"] >= south) & (box["ymin"] <= north))


def bounds_contain(outer: Bounds, inner: Bounds) -> bool:
    """Driver-side test whether one plain viewport covers another."""
    ow, os_, oe, on = check_bounds(outer)
    iw, is_, ie, in_ = check_bounds(inner)
    plain = ow <= oe and iw <= ie
    return plain and ow <= iw and os_ <= is_ and oe >= ie and on >= in_

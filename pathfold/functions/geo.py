"""Geodesy and map arithmetic as native Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_DIAMETER_M = 12_742_000.0
MERCATOR_RADIUS_M = 6_378_137.0
MERCATOR_MAX_LAT = 85.05112878
PIXEL_MAX_LAT = 85.051129


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """A number, a column name, or a Column."""
    return F.lit(float(c)) if isinstance(c, (int, float)) else col(c)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres between two positions.

    Rounding can push opposite points just outside asin's domain; they are half a turn apart.
    """
    p1, p2 = F.radians(num(lat1)), F.radians(num(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(num(lon2) - num(lon1)) / 2)
    h = F.pow(half_lat, 2.0) + F.cos(p1) * F.cos(p2) * F.pow(half_lon, 2.0)
    return F.nanvl(F.asin(F.sqrt(h)), F.lit(math.pi / 2)) * EARTH_DIAMETER_M


def clamp(c, low, high) -> Column:
    """Bounded value; null stays null (``least``/``greatest`` would skip it)."""
    c, low, high = num(c), num(low), num(high)
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def mercator_x(lon) -> Column:
    return F.radians(num(lon)) * MERCATOR_RADIUS_M


def mercator_y(lat) -> Column:
    bounded = F.radians(clamp(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return F.log(F.tan(bounded / 2 + math.pi / 4)) * MERCATOR_RADIUS_M


def inverse_mercator_lon(x) -> Column:
    return F.degrees(num(x) / MERCATOR_RADIUS_M)


def inverse_mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.exp(num(y) / MERCATOR_RADIUS_M)) * 2 - math.pi / 2)


def world_size(zoom) -> Column:
    return F.pow(F.lit(2.0), num(zoom)) * 512.0


def world_x(lon, size) -> Column:
    return (num(lon) + 180.0) / 360.0 * num(size)


def world_y(lat, size) -> Column:
    phi = F.radians(clamp(lat, -PIXEL_MAX_LAT, PIXEL_MAX_LAT))
    return (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * num(size)


def unit_x(lon) -> Column:
    """Longitude on the unit square."""
    return (num(lon) + 180.0) / 360.0


def unit_y(lat) -> Column:
    """Latitude on the unit square, north at 0."""
    s = F.sin(F.radians(clamp(lat, -PIXEL_MAX_LAT, PIXEL_MAX_LAT)))
    return F.lit(0.5) - F.log((1.0 + s) / (1.0 - s)) / (4.0 * math.pi)


def valid_coord(lon, lat) -> Column:
    return num(lon).between(-180.0, 180.0) & num(lat).between(-90.0, 90.0)


def semicircles_to_degrees(c) -> Column:
    return num(c).cast("double") * 180.0 / float(2**31)


def _interleave(c: Column) -> Column:
    """Spread 16 bits to the even bit positions, one mask per halving of the stride."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def spatial_key(lon, lat) -> Column:
    """Morton key of a position quantised to 16 bits per axis."""
    top = 65535

    def cell(value: Column, offset: float, span: float) -> Column:
        return clamp(((value + offset) / span * top), 0, top).cast("long")

    x, y = cell(num(lon), 180.0, 360.0), cell(num(lat), 90.0, 180.0)
    return _interleave(x).bitwiseOR(F.shiftleft(_interleave(y), 1))


# Simplification tolerance of each level, metres; the last level is full geometry.
LOD_TOLERANCES_M = (2048.0, 512.0, 128.0, 32.0, 8.0, 2.0, 0.5, None)
MAX_LOD = len(LOD_TOLERANCES_M) - 1

# Vertex budgets by resolution, (minimum, maximum).
VERTEX_BUDGETS_2D = {
    "low": (100_000, 500_000),
    "medium": (200_000, 750_000),
    "high": (300_000, 1_000_000),
}
VERTEX_BUDGETS_3D = {
    "low": (75_000, 325_000),
    "medium": (125_000, 500_000),
    "high": (200_000, 650_000),
}
BUDGET_ZOOMS = (7.0, 13.0)
BUDGET_QUANTUM = 50_000


def metres_per_pixel(zoom) -> Column:
    return F.lit(2 * math.pi * MERCATOR_RADIUS_M) / world_size(zoom)


def lod_for_metres_per_pixel(mpp) -> Column:
    """Coarsest level whose tolerance stays within one pixel."""
    choice = F.lit(MAX_LOD)
    for lod in range(MAX_LOD - 1, -1, -1):
        choice = F.when(num(mpp) >= LOD_TOLERANCES_M[lod], lod).otherwise(choice)
    return choice


def requested_lod(zoom, pixel_error=1.0, bias=0, pixel_metres=None) -> Column:
    mpp = metres_per_pixel(zoom)
    if pixel_metres is not None:
        mpp = F.least(mpp, num(pixel_metres))
    shifted = lod_for_metres_per_pixel(mpp * num(pixel_error)) + F.lit(int(bias))
    return F.greatest(F.lit(0), F.least(F.lit(MAX_LOD), shifted)).cast("int")


def scheduled_vertex_budget(zoom, resolution: str = "medium", three_d: bool = False) -> Column:
    """Vertex budget easing from the minimum to the maximum between two zooms."""
    low, high = (VERTEX_BUDGETS_3D if three_d else VERTEX_BUDGETS_2D)[resolution]
    start, stop = BUDGET_ZOOMS
    t = clamp((num(zoom) - start) / (stop - start), 0.0, 1.0)
    target = F.lit(float(low)) + t * t * (3.0 - t * 2.0) * float(high - low)
    return (F.floor(target / BUDGET_QUANTUM + 0.5) * BUDGET_QUANTUM).cast("long")


def padded_bounds(west, south, east, north, fraction=0.05) -> list[Column]:
    """Grow a viewport on every side; one crossing the antimeridian is left as it is."""
    w, s, e, n = num(west), num(south), num(east), num(north)
    dx, dy = (e - w) * fraction, (n - s) * fraction
    wraps = w > e
    return [
        F.when(wraps, w).otherwise(F.greatest(F.lit(-180.0), w - dx)),
        F.when(wraps, s).otherwise(F.greatest(F.lit(-85.0), s - dy)),
        F.when(wraps, e).otherwise(F.least(F.lit(180.0), e + dx)),
        F.when(wraps, n).otherwise(F.least(F.lit(85.0), n + dy)),
    ]


def fit_zoom(xmin, ymin, xmax, ymax, max_zoom=12.0) -> Column:
    """Zoom that shows a bounding box, from its larger side."""
    span = F.greatest(num(xmax) - num(xmin), (num(ymax) - num(ymin)) * 1.6, F.lit(0.001))
    return clamp(F.log2(F.lit(360.0) / span) - 0.8, 1.0, max_zoom)


def stroke_widths(width, height, scale=1.0) -> dict[str, Column]:
    """Line widths proportional to the shorter side of the map."""
    basis = F.greatest(F.lit(320.0), F.least(num(width), num(height)))
    route = basis * 0.0015 * num(scale)
    focus = F.greatest(route * 1.8, route + 1.5)
    return {
        "route": route,
        "heat": route,
        "focus": focus,
        "casing": focus + F.greatest(F.lit(1.0), basis * 0.0015),
    }


def distance_in(c, units: str) -> Column:
    return num(c) / (1609.344 if units == "imperial" else 1000.0)


def elevation_in(c, units: str) -> Column:
    return num(c) * (3.28084 if units == "imperial" else 1.0)


def normalized_pitch(pitch, default=0.0) -> Column:
    return clamp(F.coalesce(finite(num(pitch)), F.lit(float(default))), 0.0, 85.0)


def normalized_bearing(bearing) -> Column:
    return F.pmod(F.coalesce(finite(num(bearing)), F.lit(0.0)) + 180.0, F.lit(360.0)) - 180.0


def finite(c) -> Column:
    """Null instead of NaN or an infinity."""
    c = num(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)

"""Colour scales as Columns of ``array<int>`` (red, green, blue, alpha)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp, num

# Stops of the preset scales.
PRESETS = {
    "sunset": (
        (48, 64, 171, 210),
        (66, 132, 226, 220),
        (83, 205, 218, 230),
        (255, 217, 102, 240),
        (255, 112, 67, 250),
        (226, 48, 92, 255),
    ),
    "viridis": (
        (68, 1, 84, 210),
        (59, 82, 139, 220),
        (33, 145, 140, 230),
        (94, 201, 98, 242),
        (253, 231, 37, 255),
    ),
    "fire": (
        (34, 16, 52, 210),
        (87, 15, 109, 220),
        (187, 55, 84, 235),
        (249, 142, 9, 248),
        (252, 255, 164, 255),
    ),
    "ice": (
        (8, 29, 88, 210),
        (28, 89, 156, 220),
        (40, 181, 192, 235),
        (151, 235, 220, 248),
        (240, 253, 250, 255),
    ),
}
DEFAULT_STOPS = ("#440154", "#21918c", "#fde725")
HEX = re.compile(r"#[0-9a-fA-F]{6}")


def hex_stops(palette: str) -> list[str]:
    """Valid stops of a ``custom:#rrggbb,#rrggbb`` palette, in lower case."""
    if not palette.startswith("custom:"):
        return []
    return [c.lower() for c in palette[len("custom:") :].split(",") if HEX.fullmatch(c)]


def is_palette(palette) -> bool:
    return isinstance(palette, str) and (palette in PRESETS or len(hex_stops(palette)) > 1)


def custom_palette(colors) -> str:
    valid = [c.lower() for c in colors if HEX.fullmatch(c)]
    return "custom:" + ",".join(valid if len(valid) > 1 else DEFAULT_STOPS)


def _rgb(stop: str) -> tuple[int, int, int]:
    return tuple(bytes.fromhex(stop[1:]))


def hex_to_rgba(c: Column) -> Column:
    """``#rrggbb`` text to a colour, null when malformed."""

    def channel(at: int) -> Column:
        return F.conv(F.substring(c, at, 2), 16, 10).cast("int")

    rgba = F.array(channel(2), channel(4), channel(6), F.lit(255))
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), rgba)


def _interpolate(position: Column, stops) -> Column:
    """Linear interpolation of ``position`` in [0, len(stops) - 1]; null a whole stop beyond the last one."""
    last = len(stops) - 1
    lower = F.floor(position).cast("int")
    upper = F.least(F.lit(last), lower + 1)
    ratio = position - lower

    def channel(k: int) -> Column:
        values = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(values, lower), F.get(values, upper)
        return F.floor(a + (b - a) * ratio + 0.5).cast("int")

    return F.when(lower <= last, F.array(*[channel(k) for k in range(4)]))


def heat_color(weight, maximum, palette: str = "sunset", temperature: float = 1.7) -> Column:
    """Colour of a weight on a logarithmic scale up to ``maximum``."""
    custom = hex_stops(palette)
    if len(custom) > 1:
        top = len(custom) - 1
        stops = [(*_rgb(s), int(210 + 45 * i / top + 0.5)) for i, s in enumerate(custom)]
    else:
        stops = PRESETS[palette]
    ratio = F.when(num(maximum) <= 0, 0.0).otherwise(F.log1p(num(weight)) / F.log1p(num(maximum)))
    return _interpolate(F.pow(ratio, 1.0 / max(0.25, temperature)) * (len(stops) - 1), stops)


def dimension_color(
    value, step, kind: str, low, high, steps, palette: str = "viridis"
) -> Column:
    """Colour of a dimension value: by domain when numeric, else by step index.

    ``steps`` is the number of distinct steps; a null value or unknown step gives null.
    """
    numeric = kind == "numeric"
    if palette.startswith("custom:"):
        stops = [(*_rgb(s), 255) for s in (hex_stops(palette) or DEFAULT_STOPS)]
        if len(stops) < 2:
            stops = [(*_rgb(s), 255) for s in DEFAULT_STOPS]
        span = num(high) - num(low)
        at = (
            F.when(num(value).isNotNull() & (span == 0), 0.0).otherwise((num(value) - num(low)) / span)
            if numeric
            else num(step) / F.greatest(F.lit(1), num(steps) - 1)
        )
        return _interpolate(clamp(at, 0.0, 1.0) * (len(stops) - 1), stops)
    if numeric:
        over = num(value) - num(low)
        return heat_color(
            F.when(over < 0, 0.0).otherwise(over),
            F.greatest(F.lit(0.0), num(high) - num(low)),
            palette,
            1.0,
        )
    return heat_color(num(step), F.greatest(F.lit(1.0), num(steps) - 1.0), palette, 1.0)

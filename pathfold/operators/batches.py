"""Columnar hand-off of routes: flat coordinates with segment starts and owners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import GAP_M

BATCH = (
    "activity_ids array<string>, positions array<double>, start_indices array<int>, owners array<int>"
)
EARTH_DIAMETER_M = 12_742_000.0


def _legs(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.diff(q) / 2) ** 2
    return EARTH_DIAMETER_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def route_batches(lines: DataFrame, gap_m: float = GAP_M) -> DataFrame:
    """One row per Arrow batch of lines (activity_id, geometry).

    ``positions`` is lon, lat, lon, lat...; ``start_indices`` are vertex offsets of the segments
    with a closing entry; ``owners`` index ``activity_ids``.  Legs longer than ``gap_m`` start a
    new segment; one-point segments stay.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, ys = batch.column(0), batch.column(1), batch.column(2)
            ends = xs.offsets.to_numpy()
            x = xs.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            first_y = ys.offsets[0].as_py()
            y = ys.values.to_numpy(zero_copy_only=False)[first_y : first_y + len(x)]
            ends = ends - ends[0]
            begins = np.zeros(len(x), dtype=bool)
            begins[ends[:-1][ends[:-1] < ends[1:]]] = True
            if len(x) > 1:
                begins[1:] |= _legs(x, y) > gap_m
            starts = np.flatnonzero(begins)
            owners = np.searchsorted(ends, starts, side="right") - 1
            row = {
                "activity_ids": [ids.to_pylist()],
                "positions": [np.column_stack([x, y]).ravel()],
                "start_indices": [np.append(starts, len(x)).astype(np.int32)],
                "owners": [owners.astype(np.int32)],
            }
            yield pa.RecordBatch.from_pydict(
                row,
                schema=pa.schema(
                    [
                        ("activity_ids", pa.list_(pa.string())),
                        ("positions", pa.list_(pa.float64())),
                        ("start_indices", pa.list_(pa.int32())),
                        ("owners", pa.list_(pa.int32())),
                    ]
                ),
            )

    flat = lines.select(
        "activity_id",
        F.transform("geometry", lambda p: p[0]).alias("x"),
        F.transform("geometry", lambda p: p[1]).alias("y"),
    )
    return flat.mapInArrow(pack, BATCH)

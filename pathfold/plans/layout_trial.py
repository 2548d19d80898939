"""Compare file layouts by the time of a bounded scan over the densest cell."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import viewport_intersects
from ..operators.heat import dense_cell


def write_layout(rows: DataFrame, path: str, row_group_rows: int, ordered: bool = True) -> None:
    """One candidate: rows in spatial order (or as they come) with a row-group size."""
    order = ["spatial_order", "activity_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if ordered else rows
    placed.write.option("compression", "zstd").option(
        "parquet.block.row.count.limit", row_group_rows
    ).parquet(path)


def timed_scan(spark: SparkSession, path: str, box, value: str, repeats: int = 6) -> dict:
    """Median and minimum milliseconds of a bounded count and sum, after one warm-up."""
    samples = []
    for _ in range(repeats + 1):
        start = time.perf_counter()
        spark.read.parquet(path).where(viewport_intersects(box)).agg(
            F.count(F.lit(1)), F.sum(value)
        ).collect()
        samples.append((time.perf_counter() - start) * 1000)
    kept = samples[1:]
    return {"median_ms": round(statistics.median(kept), 2), "minimum_ms": round(min(kept), 2)}


def compare_layouts(
    spark: SparkSession,
    rows: DataFrame,
    folder: str,
    value: str = "vertex_count",
    sizes=(128, 512, 4096),
    repeats: int = 6,
) -> list[dict]:
    """Write each candidate under ``folder`` and time the same scan on all."""
    cell = dense_cell(rows).first()
    box = (cell.west, cell.south, cell.east, cell.north)
    results = []
    for ordered in (True, False):
        for size in sizes:
            path = f"{folder}/{'ordered' if ordered else 'plain'}-{size}"
            write_layout(rows, path, size, ordered)
            results.append(
                {"ordered": ordered, "row_group_rows": size, **timed_scan(spark, path, box, value, repeats)}
            )
    return results

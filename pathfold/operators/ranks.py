"""Exact ordinal positions that never put an unbounded group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# A group is split once it holds more rows than this.
HOT_ROWS = 1 << 20


def dense_sequence(
    df: DataFrame,
    keys: list[str],
    unique: str,
    name: str = "seq",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position inside each ``keys`` group, in the order of ``unique``.

    ``unique`` is a non-negative integer that is unique over the table, so a range of
    ``hot_rows`` of its values bounds the rows of any bucket.  Cold groups take one window;
    only groups above ``hot_rows`` are cut into buckets, numbered apart and shifted by the
    size of the buckets before them.
    """
    order = Window.partitionBy(*keys).orderBy(unique)
    plain = df.withColumn(name, (F.row_number().over(order) - 1).cast("long"))
    if df.count() <= hot_rows:  # answered from file footers for a plain scan
        return plain
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    n_hot = hot.count()
    if n_hot == 0:
        return plain
    marker = hot.withColumn("_hot", F.lit(True))
    if n_hot <= 200_000:
        marker = F.broadcast(marker)
    bucket = F.when(F.col("_hot"), F.floor(F.col(unique) / hot_rows)).otherwise(0).cast("long")
    marked = df.join(marker, keys, "left").withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        marked.where("_hot")
        .groupBy(*keys, "_bucket")
        .count()
        .select(*keys, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(unique)
    position = F.row_number().over(inner) - 1 + F.coalesce("_start", F.lit(0))
    return (
        marked.join(starts, [*keys, "_bucket"], "left")
        .withColumn(name, position.cast("long"))
        .drop("_hot", "_bucket", "_start")
    )


# Up to this k Spark itself limits each task's rows before the shuffle.
PUSHED_LIMIT = 1000


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank", salts: int = 256
) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, ranked from 1.

    A larger ``k`` is limited in salted shares of each key first, so that a crowded key does
    not meet in one task whole.
    """
    rank = F.row_number()
    if k > PUSHED_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        share = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_share", rank.over(share))
            .where(F.col("_share") <= k)
            .drop("_salt", "_share")
        )
    ranked = df.withColumn(name, rank.over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """0-based position in a total order, without a single-partition window.

    Rows are range-partitioned and sorted on ``order`` (which must end in a unique column),
    the layout is pinned with a reliable checkpoint, and each partition is shifted by the
    rows before it.  The offsets table has one row per partition.
    """
    laid_out = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    offsets = (
        laid_out.groupBy(part.alias("_part"))
        .count()
        .select(
            "_part",
            F.coalesce(
                F.sum("count").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (inside + F.col("_offset")).cast("long"))
        .drop("_at", "_part", "_offset")
    )

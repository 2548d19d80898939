"""Dataset writers: canonical shards, metadata, render pyramid, rejections, manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import LOD_TOLERANCES_M
from ..operators.layout import FILE_BYTES, GROUP_BYTES, render_row_bytes, str_layout
from ..operators.ranks import global_rank
from ..operators.simplify import (
    LINES,
    at_target,
    keep_above,
    level_geometry,
    line_extent,
    split_long,
    target_thresholds,
    with_long_significance,
    with_significance,
)
from ..operators.tracks import CHUNK_POINTS, with_lines
from ..schema import (
    BOUNDS,
    CANONICAL,
    CLEAN_BOUNDS,
    COMPILER_VERSION,
    GEOMETRY_COLUMNS,
    LINE_TARGETS,
    METADATA,
    RENDER,
    RENDER_PYRAMID_VERSION,
    SCALARS,
    SCHEMA_VERSION,
)
from ..sources import geo_parquet
from ..sources.dataset import FILES, read_manifest, scan_canonical, version_of  # noqa: F401
from ..sources.files import row_group_facts
from ..sources.geo_parquet import geo_footer
from ..session import cut_lineage
from .paths import delete, exists, qualified, write_text

METADATA_GROUP_ROWS = 4096
# Above any row group the row limit closes, so that the limit alone decides.
WIDE_BLOCK_BYTES = 1 << 30


def coarse_lines(rows: DataFrame) -> DataFrame:
    """Add the stored vertex-target lines of one-part tracks."""
    out = with_significance(rows)
    return out.withColumns(
        {
            f"{name}_lod{i}": at_target(
                F.col(name), F.col(f"{prefix}sig_deg"), line_extent(F.col(name)), target
            )
            for name, prefix in LINES
            for i, target in enumerate(LINE_TARGETS)
        }
    )


def long_coarse_lines(wide: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """``coarse_lines`` for tracks of several parts: one threshold per track and target."""
    out = with_long_significance(wide, chunk_points)
    for name, prefix in LINES:
        sig = F.col(f"{prefix}sig_deg")
        cuts = target_thresholds(out, name, f"{prefix}sig_deg", LINE_TARGETS)
        out = (
            out.join(cuts, "activity_id")
            .withColumns(
                {
                    f"{name}_lod{i}": keep_above(F.col(name), sig, F.col(f"t{t}"))
                    for i, t in enumerate(LINE_TARGETS)
                }
            )
            .drop(*[f"t{t}" for t in LINE_TARGETS])
        )
    return out


def write_canonical(
    rows: DataFrame,
    root: str,
    shard_rows: int = 512,
    row_group_rows: int = 128,
    chunk_points: int = CHUNK_POINTS,
    progress: Observation | None = None,
) -> None:
    """Shards by family in (spatial_order, activity_id) order, with exact row-group sizes.

    The coarse lines are added after the range shuffle, whose sampling pass would otherwise
    simplify everything twice; those of longer tracks take joins and are added before it. So are
    the lines themselves, of rows that come with ``track_points`` alone.
    """
    if shard_rows < 1:
        raise ValueError("target shard rows must be positive")
    if not 1 <= row_group_rows <= shard_rows:
        raise ValueError("row group rows must be positive and no larger than the shard target")
    order = ["activity_family", "spatial_order", "activity_id", "part"]
    columns = [*CANONICAL.fieldNames(), "activity_family"]
    if "geometry_lod0" in rows.columns:
        placed = rows.repartitionByRange(*order)
    else:
        lined = (lambda r: r) if "geometry" in rows.columns else with_lines
        single, wide = split_long(rows)
        placed = coarse_lines(lined(single.repartitionByRange(*order))).select(*columns)
        if wide is not None:
            long = long_coarse_lines(lined(wide), chunk_points).select(*columns)
            placed = placed.unionByName(long).repartitionByRange(*order)
    ordered = placed.select(*columns).sortWithinPartitions(*order)
    if progress is not None:  # after the range shuffle, which samples its input
        ordered = ordered.observe(progress, F.count_if(F.col("part") == 0).alias("completed"))
    write_geo(
        ordered,
        f"{root}/activities",
        partition="activity_family",
        group_rows=row_group_rows,
        file_rows=shard_rows,
    )


def write_geo(rows: DataFrame, path: str, **options) -> None:
    """Write sorted rows as GeoParquet; refuses an existing folder."""
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"output already exists: {path}")
    geo_parquet.register(spark)
    writer = rows.write.format(geo_parquet.FORMAT).mode("append")
    for name, value in {"path": qualified(spark, path), **options}.items():
        writer = writer.option(name, value)
    writer.save()


def locators(spark: SparkSession, root: str, row_group_rows: int = 128) -> DataFrame:
    """Scalars of every activity with the shard and row group that hold its first part."""
    path = F.col("_metadata.file_path")
    place = {
        "canonical_path": F.concat(F.lit("activities/"), F.substring_index(path, "/activities/", -1)),
        "canonical_row_group": F.floor(F.col("_metadata.row_index") / row_group_rows).cast("int"),
    }
    return (
        scan_canonical(spark, root, place)
        .select(*SCALARS.fieldNames(), "activity_family", "part", *place)
        .where("part = 0")
        .drop("part")
    )


def write_metadata(spark: SparkSession, root: str, row_group_rows: int = 128, source: str | None = None) -> None:
    """Light index read back from the shards (of ``source``, if given), so every row carries a true locator."""
    # Pinned, since the shards would be opened again for the count, the sampling pass and the rows.
    rows = cut_lineage(locators(spark, source or root, row_group_rows))
    counted = rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("activity_id").alias("ids")
    ).first()
    if counted.n != counted.ids:
        raise ValueError(f"{counted.n - counted.ids} activities are stored more than once")
    order = ["spatial_order", "activity_id"]
    (
        rows.select(*METADATA.fieldNames())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", METADATA_GROUP_ROWS)
        .option("parquet.block.size", WIDE_BLOCK_BYTES)
        .parquet(f"{root}/metadata")
    )


def carry_over(levels: DataFrame) -> DataFrame:
    """Start each part's lines with the last vertex of the part before it that has any.

    ``levels`` holds the rows of tracks of several parts.  The vertex counts stay those of the
    part, so a line is one vertex longer than its count where it goes on from an earlier part.
    """
    track = Window.partitionBy("activity_id", "lod").orderBy("part")  # one light row a part
    ends = levels.select(
        "activity_id", "lod", "part", *[F.get(n, F.size(n) - 1).alias(f"_{n}") for n in LINE_NAMES]
    )
    earlier = track.rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        "activity_id", "lod", "part", *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in LINE_NAMES]
    )
    return levels.join(before, ["activity_id", "lod", "part"]).withColumns(
        {
            n: F.when((F.size(n) > 0) & F.col(f"_{n}").isNotNull(), F.concat(F.array(f"_{n}"), n)).otherwise(F.col(n))
            for n in LINE_NAMES
        }
    ).drop(*[f"_{n}" for n in LINE_NAMES])


LINE_NAMES = ("geometry", "geometry_clean")
SIG_NAMES = ("r_sig_m", "c_sig_m")
RENDER_HEADS = ["activity_id", *BOUNDS, *CLEAN_BOUNDS, "spatial_order", "part"]
LEVELS = range(len(LOD_TOLERANCES_M))


def leveled(measured: DataFrame, *places: str) -> DataFrame:
    """A row for each level of rows with lines and their significance in metres.

    ``places`` are array columns of a value for each level, which goes with its row.
    """
    levels = F.array(
        *[
            F.struct(
                F.lit(lod).alias("lod"),
                *[level_geometry(F.col(n), F.col(s), lod).alias(n) for n, s in zip(LINE_NAMES, SIG_NAMES, strict=True)],
                *[F.get(p, F.lit(lod)).alias(p) for p in places],
            )
            for lod in LEVELS
        ]
    )
    rows = measured.select(*RENDER_HEADS, F.explode(levels).alias("l")).select(*RENDER_HEADS, "l.*")
    return rows.withColumns(
        {
            "vertex_count": F.size("geometry").cast("long"),
            "clean_vertex_count": F.size("geometry_clean").cast("long"),
        }
    )


def long_levels(wide: DataFrame, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """The levels of tracks of several parts: a part's line starts where the one before ended."""
    return carry_over(leveled(with_long_significance(wide, chunk_points))).select(*RENDER.fieldNames(), "lod")


def render_levels(
    canonical: DataFrame, chunk_points: int = CHUNK_POINTS, several: bool | None = None
) -> DataFrame:
    """One row per (activity, part, level) with both simplified lines and their sizes.

    The parts of a track are one route: a part's line starts where the one before ended.
    """
    single, wide = split_long(canonical.select(*RENDER_HEADS, *LINE_NAMES), several)
    out = leveled(with_significance(single)).select(*RENDER.fieldNames(), "lod")
    return out if wide is None else out.unionByName(long_levels(wide, chunk_points))


def write_render_pyramid(
    spark: SparkSession,
    root: str,
    chunk_points: int = CHUNK_POINTS,
    group_bytes: int = GROUP_BYTES,
    file_bytes: int = FILE_BYTES,
    source: str | None = None,
) -> None:
    """Eight levels in sort-tile-recursive order.

    Lines are measured once and stored with their significance, which gives the sizes of all levels. The
    layout is decided on those, and a line becomes its eight levels on the way to the final files;
    only those of tracks of several parts are stored as levels.
    """
    staged = f"{root.rstrip('/')}-levels"
    try:
        canonical = scan_canonical(spark, source or root).select(*RENDER_HEADS, *LINE_NAMES)
        single, wide = split_long(canonical)
        measured = with_significance(single).select(*RENDER_HEADS, *LINE_NAMES, *SIG_NAMES)
        measured.withColumn("sizes", level_sizes()).write.option("compression", "zstd").parquet(f"{staged}/lines")
        long = None
        if wide is not None:
            long_levels(wide, chunk_points).write.option("compression", "zstd").parquet(f"{staged}/long")
            long = spark.read.parquet(f"{staged}/long")
        _write_levels(spark.read.parquet(f"{staged}/lines"), long, root, group_bytes, file_bytes)
    finally:
        delete(spark, staged)


def level_sizes() -> Column:
    """Vertices of both lines at each level, from the significance alone."""

    def kept(line: str, sig: str, lod: int) -> Column:
        tolerance = LOD_TOLERANCES_M[lod]
        count = F.size(F.filter(sig, lambda s: s > tolerance)) if tolerance else F.size(line)
        return count.cast("long")

    names = ("vertex_count", "clean_vertex_count")
    return F.array(
        *[
            F.struct(F.lit(lod).alias("lod"), *[kept(n, s, lod).alias(c) for n, s, c in zip(LINE_NAMES, SIG_NAMES, names, strict=True)])
            for lod in LEVELS
        ]
    )


def _write_levels(lines: DataFrame, long: DataFrame | None, root: str, group_bytes: int, file_bytes: int) -> None:
    key, group = ["activity_id", "part"], ["lod", "stripe", "group_no"]
    sized = lines.select(*key, *BOUNDS, F.explode("sizes").alias("s")).select(*key, *BOUNDS, "s.*")
    if long is not None:
        sized = sized.unionByName(long.select(*sized.columns))
    sized = sized.select(*key, "lod", *BOUNDS, render_row_bytes().alias("bytes"))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    placed = cut_lineage(str_layout(sized, group_bytes).select(*key, *group))
    # Tasks take runs of groups, of about as many bytes each, so that no pass over the lines samples them.
    groups = global_rank(placed.select(*group).distinct(), group, "at")
    n = groups.count()
    cores = lines.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(len(LEVELS), cores, -(-int(total) // file_bytes))))
    placed = placed.join(groups, group).withColumn("task", F.floor(F.col("at") * tasks / F.lit(n)).cast("int"))
    places = placed.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("lod", "stripe", "group_no", "task"))).alias("place")  # one a level
    )
    columns = [*RENDER.fieldNames(), "lod", "place"]
    rows = leveled(lines.join(places, key), "place").select(*columns)
    if long is not None:
        place = F.struct("lod", "stripe", "group_no", "task").alias("place")
        rows = rows.unionByName(long.join(placed.select(*key, "lod", place), [*key, "lod"]).select(*columns))
    ordered = (
        rows.select(*RENDER.fieldNames(), "lod", "place.stripe", "place.group_no", "place.task")
        .repartitionById(tasks, "task")
        .sortWithinPartitions(*group, *key)
        .drop("task")
    )
    write_geo(
        ordered,
        f"{root}/render",
        partition="lod",
        group="stripe,group_no",
        file_bytes=file_bytes,
    )


def write_rejections(rejections: DataFrame, root: str) -> None:
    rejections.write.mode("errorifexists").option("compression", "zstd").parquet(
        f"{root}/rejections"
    )


def _box(row) -> list[float]:
    return [row.xmin, row.ymin, row.xmax, row.ymax]


def build_manifest(
    spark: SparkSession, root: str, extra: dict | None = None, kinds: tuple[str, ...] = ("activities", "metadata", "render")
) -> dict:
    """Row-group table under ``manifest/``, file table, and a ``dataset.json`` of totals and levels.

    Both tables grow with the data and stay tables at any size; ``dataset.json`` names the file
    table under ``files``.
    """
    facts = row_group_facts(spark, root, *kinds)  # those the build has files of its own of
    lod = F.when(F.col("kind") == "render", F.regexp_extract("path", r"/lod=(\d+)/", 1).cast("int"))
    facts.withColumn("lod", lod).write.mode("errorifexists").option("compression", "zstd").parquet(
        f"{root}/manifest"
    )
    facts = spark.read.parquet(f"{root}/manifest")
    box = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    files = facts.groupBy("kind", "lod", "path").agg(
        F.sum("row_count").alias("row_count"),
        F.first("byte_size").alias("byte_size"),
        F.first("sha256").alias("sha256"),
        F.count(F.lit(1)).alias("row_group_count"),
        *box,
    )
    order = ["kind", "lod", "path"]
    ordered = files.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/{FILES}")
    files = spark.read.parquet(f"{root}/{FILES}")
    levels = (
        files.groupBy("kind", "lod")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.sum("byte_size").alias("byte_size"),
            F.count(F.lit(1)).alias("file_count"),
            F.sum("row_group_count").alias("row_group_count"),
            *box,
        )
        .orderBy("kind", "lod")
        .collect()  # one row per kind and level
    )
    totals = spark.read.parquet(f"{root}/metadata").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("start_time").cast("string").alias("first"),
        F.max("start_time").cast("string").alias("last"),
        *box,
    ).first()
    sources = dict(
        sorted(
            (r.source_type, r.n)
            for r in spark.read.parquet(f"{root}/metadata")
            .groupBy("source_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()  # one row per supported file type
        )
    )
    rejected = spark.read.parquet(f"{root}/rejections").count()
    manifest = {
        "schema_version": SCHEMA_VERSION,
        "compiler_version": COMPILER_VERSION,
        "render_pyramid_version": RENDER_PYRAMID_VERSION,
        "relation": "activities",
        "activity_count": totals.n,
        "rejection_count": rejected,
        "bbox": _box(totals),
        "first_activity": totals.first,
        "last_activity": totals.last,
        "files": FILES,
        "render_levels": [
            {
                "lod": level.lod,
                "tolerance_m": LOD_TOLERANCES_M[level.lod],
                "spatial_layout": "str",
                "row_count": level.row_count,
                "byte_size": level.byte_size,
                "bbox": _box(level),
                "file_count": level.file_count,
                "row_group_count": level.row_group_count,
            }
            for level in levels
            if level.kind == "render"
        ],
        "source_counts": sources,
        "geo": geo_footer(_box(totals), GEOMETRY_COLUMNS),
        **(extra or {}),
    }
    write_text(spark, f"{root}/dataset.json", json.dumps(manifest, indent=2) + "\n")
    return manifest


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of the dataset at ``root``: of a store, those of all builds of the active version.

    ``path`` is relative to ``root``, or to the store that a build with parts lies in.
    """
    root = root.rstrip("/")
    version, out = version_of(spark, root), None
    base = root.rsplit("/builds/", 1)[0] if "parts" in version.manifest else root
    for kind, folders in version.folders.items():
        for folder in folders if kind != "rejections" else ():  # the table lists no rejections
            rows = spark.read.parquet(f"{folder}/{FILES}").where(F.col("kind") == kind)
            inside = f"{folder}/"[len(base) + 1 :]
            rows = rows.withColumn("path", F.concat(F.lit(inside), "path"))
            out = rows if out is None else out.unionByName(rows)
    return out

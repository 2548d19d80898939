"""Readers of a compiled dataset.

A dataset is a folder of its own, or a store: ``builds/<id>`` folders and a ``dataset.json`` that
names the active build and the builds whose files the version is made of. Readers take the files that
a build's file table names (while it is written: its sink's lists), never whatever a folder
holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Bounds, bounds_intersect, viewport_intersects
from ..plans.paths import exists, qualified
from ..schema import BOUNDS, RENDER
from ..session import use_utc
from .files import open_uri
from .geo_parquet import LISTS

FILES = "manifest_files"
KINDS = ("activities", "metadata", "render", "rejections")
FAMILY = re.compile(r"(?:^|/)activity_family=([^/]+)/")


def family_of(path: str) -> str:
    found = FAMILY.search(path)
    if not found:
        raise ValueError(f"canonical file is outside the activity_family layout: {path}")
    return found.group(1)


def read_manifest(spark: SparkSession, root: str) -> dict:
    rows = spark.read.text(f"{root}/dataset.json", wholetext=True).take(1)
    if not rows:
        raise ValueError(f"{root} has no dataset.json")
    return json.loads(rows[0][0])


@dataclass(frozen=True)
class Version:
    """What a root stands for: its manifest, and the folders that hold the files of each kind."""

    manifest: dict
    folders: dict[str, list[str]]


def part_folders(store: str, parts: list[dict]) -> dict[str, list[str]]:
    """Folders by kind of a version's parts, ``{"build": id, "kinds": [...]}`` in order."""
    return {k: [f"{store}/builds/{p['build']}" for p in parts if k in p["kinds"]] for k in KINDS}


def version_of(spark: SparkSession, root: str) -> Version:
    root = root.rstrip("/")
    manifest = read_manifest(spark, root) if exists(spark, f"{root}/dataset.json") else {}
    own = f"{root}/{manifest.get('build_path', '')}".rstrip("/")
    if "parts" not in manifest:
        return Version(manifest, {k: [own] for k in KINDS})
    store = root if "build_path" in manifest else root.rsplit("/builds/", 1)[0]
    return Version(manifest, part_folders(store, manifest["parts"]))


def listed_files(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """(path, lod) of a build's files of a kind, or None where a folder's content counts."""
    if exists(spark, f"{folder}/{FILES}"):
        return spark.read.parquet(f"{folder}/{FILES}").where(F.col("kind") == kind).select("path", "lod")
    if exists(spark, f"{folder}/{kind}/{LISTS}"):
        names = spark.read.text(f"{folder}/{kind}/{LISTS}")
        lod = F.regexp_extract("value", r"^lod=(\d+)/", 1).try_cast("int")
        return names.select(F.concat(F.lit(f"{kind}/"), "value").alias("path"), lod.alias("lod"))
    return None


def scan(
    spark: SparkSession, folders: Sequence[str], kind: str, lod: int | None = None, added: dict[str, Column] | None = None
) -> DataFrame | None:
    """The rows of a kind in the given builds, None without a file.

    ``added`` columns may use the scan's file metadata, which a union hides.
    The paths pass through the driver, as in any file index of Spark; :func:`scan_viewport` does
    without.
    """
    use_utc(spark)
    out = None
    for folder in folders:
        listed = listed_files(spark, folder, kind)
        if listed is None:
            rows = spark.read.parquet(f"{folder}/{kind}")
        else:
            if lod is not None:
                listed = listed.where(F.col("lod") == lod)
            paths = [f"{folder}/{r.path}" for r in listed.select("path").distinct().collect()]
            if not paths:
                continue
            rows = spark.read.option("basePath", f"{folder}/{kind}").parquet(*paths)
        if added:
            rows = rows.withColumns(added)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def scan_canonical(spark: SparkSession, root: str, added: dict[str, Column] | None = None) -> DataFrame:
    """All canonical shards; the family comes from the partition folder.

    A listed file outside the ``activity_family`` layout is refused.
    """
    folders = version_of(spark, root).folders["activities"]
    for folder in folders:
        listed = listed_files(spark, folder, "activities")
        if listed is not None:
            for r in listed.where(~F.col("path").rlike(r"^activities/activity_family=[^/]+/[^/]+$")).take(1):
                family_of(r.path.split("/", 1)[-1])
                raise ValueError(f"canonical file is outside the activity_family layout: {r.path}")
    rows = scan(spark, folders, "activities", added=added)
    if rows is None or "activity_family" not in rows.columns:
        raise ValueError(f"no activity_family partitions under {root}/activities")
    return rows


def locate(paths: Sequence[str], canonical_path: str) -> str:
    """The one registered path a locator names."""
    wanted = canonical_path.lstrip("/")
    hits = [p for p in paths if p == wanted or p.endswith(f"/{wanted}")]
    if not hits:
        raise ValueError(f"canonical locator is not registered: {canonical_path}")
    if len(hits) > 1:
        raise ValueError(f"canonical locator is ambiguous: {canonical_path}")
    return hits[0]


def scan_canonical_file(spark: SparkSession, root: str, canonical_path: str) -> DataFrame:
    """Exactly one shard, by the locator stored in the metadata."""
    family_of(f"/{canonical_path}")
    if ".." in canonical_path.split("/"):
        raise ValueError(f"canonical locator leaves the dataset: {canonical_path}")
    folders = version_of(spark, root).folders["activities"]
    if len(folders) > 1:  # the one build that has it
        folders = [f for f in folders if not listed_files(spark, f, "activities").where(F.col("path") == canonical_path).isEmpty()]
    if len(folders) != 1:
        raise ValueError(f"canonical locator is not registered: {canonical_path}")
    return spark.read.option("basePath", f"{folders[0]}/activities").parquet(f"{folders[0]}/{canonical_path}")


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    rows = scan(spark, version_of(spark, root).folders["metadata"], "metadata")
    if rows is None:
        raise ValueError(f"no metadata under {root}")
    return rows


def scan_rejections(spark: SparkSession, root: str) -> DataFrame:
    """Rejected rows. Files are matched anew in every build, so the last one's matches count."""
    *earlier, last = version_of(spark, root).folders["rejections"]
    out = spark.read.parquet(f"{last}/rejections")
    for folder in earlier:
        out = out.unionByName(spark.read.parquet(f"{folder}/rejections").where("stage = 'parse'"))
    return out


def scan_render(
    spark: SparkSession,
    root: str,
    lod: int | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Render rows of one level (or all); with bounds, from the row groups that meet them alone."""
    folders = version_of(spark, root).folders["render"]
    listed = all(exists(spark, f"{f}/manifest") for f in folders)
    if bounds is not None and listed:
        return scan_viewport(spark, folders, lod, bounds, seen).where(viewport_intersects(bounds, clean))
    rows = scan(spark, folders, "render", lod)
    if rows is None:
        raise ValueError(f"no render files under {root}")
    if lod is not None:
        rows = rows.where(F.col("lod") == lod)
    return rows.where(viewport_intersects(bounds, clean))


RENDERED = T.StructType([*RENDER.fields, T.StructField("lod", T.IntegerType())])


def scan_viewport(
    spark: SparkSession, folders: Sequence[str], lod: int | None, bounds: Bounds, seen: Observation | None = None
) -> DataFrame:
    """Render rows of the row groups whose box meets the bounds (clean lines lie in the same box).

    The row-group table is filtered and dealt out by Spark, so neither paths nor footers pass
    through the driver; a file without such a group is never opened. ``seen`` observes files,
    row_groups and rows as they are read.
    """
    use_utc(spark)
    groups = None
    for folder in folders:
        rows = spark.read.parquet(f"{folder}/manifest").where("kind = 'render'")
        rows = rows.withColumn("uri", F.concat(F.lit(f"{qualified(spark, folder)}/"), "path"))
        groups = rows if groups is None else groups.unionByName(rows)
    if lod is not None:
        groups = groups.where(F.col("lod") == lod)
    groups = groups.withColumn("box", F.struct(*BOUNDS)).where(bounds_intersect("box", bounds))
    per_file = groups.groupBy("uri", "lod").agg(F.sort_array(F.collect_list("row_group")).alias("row_groups"), F.sum("row_count").alias("rows"))
    if seen is not None:
        per_file = per_file.observe(
            seen,
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum(F.size("row_groups")), F.lit(0)).alias("row_groups"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        )
    names = RENDERED.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, level, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                fs, path = open_uri(uri)
                with fs.open_input_file(path) as handle:
                    parquet = pq.ParquetFile(handle)
                    for part in parquet.iter_batches(1024, row_groups=wanted, columns=names[:-1]):
                        columns = [_plain(part.column(i)) for i in range(part.num_columns)]
                        columns.append(pa.array([level] * part.num_rows, pa.int32()))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return per_file.select("uri", "lod", "row_groups").mapInArrow(read, RENDERED)


def _plain(column: pa.Array) -> pa.Array:
    """Lines as lists of lists, as Spark takes them."""
    if not pa.types.is_list(column.type):
        return column
    return column.cast(pa.list_(pa.list_(pa.float64())))


def discover_datasets(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, schema_version, build_id, activity_count) of many dataset manifests."""
    schema = (
        "schema_version string, activity_count long, rejection_count long, "
        "render_pyramid_version string, build struct<id string, created_at string>"
    )
    return spark.read.schema(schema).json(pattern, multiLine=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.coalesce("schema_version", F.lit("unknown")).alias("schema_version"),
        F.col("build.id").alias("build_id"),
        F.coalesce("activity_count", F.lit(0)).alias("activity_count"),
        "render_pyramid_version",
    )

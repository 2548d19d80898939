"""Datasets that grow: a store's base build, delta builds of new files, and versions that list both.

A delta is compiled like any dataset, into a build folder that nobody reads. Its ``dataset.json`` then
becomes the manifest of the version: the totals of all builds, and ``parts``, the builds with the
kinds of files that each gives. One replacement of the store's pointer makes it visible.

What is new is told from the state: files that the version has neither stored nor rejected when
they were parsed. So a batch that comes again finds nothing to do, and a build that was left half
done is made anew under its name, which follows from its files.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalar as sc
from ..sources.dataset import KINDS, part_folders, read_manifest, scan_metadata, scan_rejections, version_of
from ..sources.files import plain_path, remove_files
from ..streaming.live import watch_archives
from .builds import build_root, check_build_id, point, versioned_manifest
from .compile import ArchiveAdapter, CompileOptions, compile_dataset, gathered
from .paths import delete, exists, qualified, write_text
from .writers import manifest_files


def start_store(spark: SparkSession, adapter, store: str, build_id: str = "base", options: CompileOptions = CompileOptions()) -> dict:
    """Compile a source as the first build of a store, and point to it."""
    store = store.rstrip("/")
    manifest = compile_dataset(spark, adapter, build_root(store, build_id), options)
    published = versioned_manifest(manifest, build_id)
    point(spark, store, published)
    return published


def current_parts(manifest: dict) -> list[dict]:
    return manifest.get("parts") or [{"build": manifest["build"]["id"], "kinds": list(KINDS)}]


def new_records(spark: SparkSession, adapter: ArchiveAdapter, store: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of an archive's matching, the records less those of files that the active
    version has stored or rejected."""
    matched, rejections = adapter.match(spark)
    stored = scan_metadata(spark, store).select(sc.basename("source_filename").alias("file_name"))
    refused = scan_rejections(spark, store).where("stage = 'parse'").select(F.col("source_path").alias("file_name"))
    return matched.join(stored.unionByName(refused), "file_name", "left_anti"), rejections


def new_files(spark: SparkSession, adapter: ArchiveAdapter, store: str) -> DataFrame:
    """file_name of matched archive files that the active version has neither stored nor rejected."""
    return new_records(spark, adapter, store)[0].select("file_name").distinct()


def _merged(spark: SparkSession, store: str, before: dict, delta: dict, parts: list[dict]) -> dict:
    """Totals of the version before and a delta."""

    def box(a: list[float], b: list[float]) -> list[float]:
        return [*map(min, a[:2], b[:2]), *map(max, a[2:], b[2:])]

    out = {k: v for k, v in before.items() if k not in ("build_path", "build")} | {"parts": parts}
    last = part_folders(store, parts)["rejections"]
    rejected = [spark.read.parquet(f"{f}/rejections").where("stage = 'parse'" if f != last[-1] else "true") for f in last]
    out["rejection_count"] = sum(r.count() for r in rejected)
    if not delta["activity_count"]:
        return out
    out["activity_count"] += delta["activity_count"]
    out["bbox"] = box(out["bbox"], delta["bbox"])
    out["first_activity"] = min(out["first_activity"], delta["first_activity"])
    out["last_activity"] = max(out["last_activity"], delta["last_activity"])
    counts = out["source_counts"]
    out["source_counts"] = {k: counts.get(k, 0) + delta["source_counts"].get(k, 0) for k in sorted({*counts, *delta["source_counts"]})}
    summed = ("row_count", "byte_size", "file_count", "row_group_count")
    out["render_levels"] = [
        {**a, **{k: a[k] + b[k] for k in summed}, "bbox": box(a["bbox"], b["bbox"])}
        for a, b in zip(out["render_levels"], delta["render_levels"], strict=True)
    ]
    columns = {n: {**c, "bbox": out["bbox"]} for n, c in out["geo"]["columns"].items()}
    out["geo"] = {**out["geo"], "columns": columns}
    return out


def append(
    spark: SparkSession, adapter: ArchiveAdapter, store: str, max_files: int = 1000, options: CompileOptions = CompileOptions()
) -> list[str]:
    """Compile what is new in an archive, ``max_files`` a build, and publish each; the new build ids.

    A file that changes after it was stored stays as it was. The archive is listed and matched once for all
    builds of what is found, then again until nothing is new, so a rejection for a missing file goes when
    the file has come.
    """
    store = store.rstrip("/")
    made = []
    while True:
        records, rejections = (gathered(rows).persist() for rows in new_records(spark, adapter, store))
        lot = ArchiveAdapter(adapter.root, adapter.decoded, matched=(records, rejections))
        waiting = records.select("file_name").distinct()
        try:
            names = _next_files(waiting, None, max_files)
            if not names:
                return made
            while names:
                made.append(_append_build(spark, replace(lot, only=names), store, options))
                names = _next_files(waiting, names[-1], max_files) if len(names) == max_files else ()
        finally:
            records.unpersist()
            rejections.unpersist()


def _next_files(waiting: DataFrame, last: str | None, max_files: int) -> tuple[str, ...]:
    """The first names after ``last``, at most ``max_files``."""
    rest = waiting if last is None else waiting.where(F.col("file_name") > last)
    return tuple(r.file_name for r in rest.orderBy("file_name").limit(max_files).collect())


def _append_build(spark: SparkSession, only: ArchiveAdapter, store: str, options: CompileOptions) -> str:
    """Compile the named files of an archive and publish the version with them."""
    before = read_manifest(spark, store)
    digest = hashlib.sha256("\n".join([before["build"]["id"], *only.only]).encode()).hexdigest()
    build_id = check_build_id(f"delta-{digest[:16]}")
    folder = build_root(store, build_id)
    delete(spark, folder)  # of a run that ended before it pointed here
    delta = compile_dataset(spark, only, folder, CompileOptions(**{**vars(options), "allow_empty": True}))
    kinds = list(KINDS) if delta["activity_count"] else ["rejections"]
    parts = [*current_parts(before), {"build": build_id, "kinds": kinds}]
    if delta["activity_count"]:
        own = spark.read.parquet(f"{folder}/metadata").select("activity_id")
        again = scan_metadata(spark, store).select("activity_id").join(own, "activity_id", "left_semi").take(3)
        if again:
            raise ValueError(f"stored before under another file: {[r.activity_id for r in again]}")
    merged = _merged(spark, store, before, delta, parts)
    write_text(spark, f"{folder}/dataset.json", json.dumps(merged, indent=2) + "\n")
    point(spark, store, versioned_manifest(merged, build_id))
    return build_id


def watch(
    spark: SparkSession, adapter: ArchiveAdapter, store: str, checkpoint: str, max_files: int = 1000, available_now: bool = True
) -> StreamingQuery:
    """Append whenever files arrive in the archive's folder."""
    return watch_archives(
        spark, f"{adapter.root}/activities", checkpoint, lambda files, batch: append(spark, adapter, store, max_files) and None, available_now
    )


def clean_store(spark: SparkSession, store: str, keep: tuple[str, ...] = ()) -> int:
    """Delete data files that neither the active version nor those of the builds in ``keep`` name.

    Not to be run beside a compile into the same store, whose files nobody names yet.
    """
    store = store.rstrip("/")
    named = manifest_files(spark, store).select("path")
    for build_id in keep:
        if exists(spark, f"{build_root(store, build_id)}/dataset.json"):
            files = manifest_files(spark, build_root(store, build_id)).select("path")
            own = "parts" not in version_of(spark, build_root(store, build_id)).manifest
            named = named.unionByName(files.withColumn("path", F.concat(F.lit(f"builds/{build_id}/"), "path")) if own else files)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{store}/builds")
    uri = plain_path("path")
    data = listed.select(uri.alias("uri")).where(F.col("uri").rlike("/builds/[^/]+/(activities|metadata|render)/"))
    start = len(qualified(spark, store)) + 2
    data = data.withColumn("path", F.expr(f"substring(uri, {start})"))
    return remove_files(data.join(named.distinct(), "path", "left_anti"))

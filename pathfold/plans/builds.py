"""Immutable builds, the manifest that selects one, and the build registry."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import BUILD_ID
from ..operators.registry import latest_per_key
from ..schema import COMPILER_VERSION, SCHEMA_VERSION
from .paths import exists, write_text
from .writers import manifest_files, read_manifest

REGISTRY = (
    "dataset_id string, build_id string, status string, event string, owner string, "
    "schema_version string, compiler_version string, render_version string, "
    "activity_count long, byte_size long, at timestamp"
)


def check_build_id(build_id: str) -> str:
    if not re.fullmatch(BUILD_ID, build_id):
        raise ValueError(f"not a build id: {build_id!r}")
    return build_id


def default_build_id(now: datetime | None = None) -> str:
    return f"schema-{SCHEMA_VERSION}-{(now or datetime.now(UTC)):%Y%m%d%H%M%S}"


def versioned_manifest(manifest: dict, build_id: str) -> dict:
    """Stable-root manifest that names the folder of one build; its paths are relative to that."""
    return {
        **manifest,
        "build_path": f"builds/{check_build_id(build_id)}/",
        "build": {"id": build_id, "created_at": datetime.now(UTC).isoformat().replace("+00:00", "Z")},
    }


def build_root(root: str, build_id: str) -> str:
    return f"{root.rstrip('/')}/builds/{check_build_id(build_id)}"


def _append(spark: SparkSession, registry: str, rows: list[dict]) -> None:
    names = [f.split()[0] for f in REGISTRY.split(", ")]
    data = [tuple(r.get(n) for n in names) for r in rows]
    spark.createDataFrame(data, REGISTRY).coalesce(1).write.mode("append").parquet(registry)


def publish_build(
    spark: SparkSession, root: str, dataset_id: str, build_id: str, registry: str, owner: str | None = None
) -> dict:
    """Make a finished build under ``root/builds/<id>`` the active one; the pointer goes last."""
    source = build_root(root, build_id)
    manifest = read_manifest(spark, source)
    published = versioned_manifest(manifest, build_id)
    size = manifest_files(spark, source).agg(F.sum("byte_size")).first()[0]
    facts = {
        "dataset_id": dataset_id,
        "build_id": build_id,
        "owner": owner,
        "schema_version": manifest["schema_version"],
        "compiler_version": manifest.get("compiler_version", COMPILER_VERSION),
        "render_version": manifest.get("render_pyramid_version", "1"),
        "activity_count": manifest["activity_count"],
        "byte_size": size,
        "at": datetime.now(UTC),
    }
    _append(
        spark,
        registry,
        [{**facts, "status": "ready", "event": "built"}, {**facts, "status": "ready", "event": "activated"}],
    )
    point(spark, root, published)
    return published


def point(spark: SparkSession, root: str, published: dict) -> None:
    """Make a version the one that readers of the root see, in one step."""
    write_text(spark, f"{root}/dataset.json", json.dumps(published, indent=2) + "\n")


def rollback(spark: SparkSession, root: str, dataset_id: str, build_id: str, registry: str) -> dict:
    """Point the stable manifest back at an earlier build."""
    if not exists(spark, f"{build_root(root, build_id)}/dataset.json"):
        raise ValueError(f"no such build: {build_id}")
    published = versioned_manifest(read_manifest(spark, build_root(root, build_id)), build_id)
    _append(
        spark,
        registry,
        [
            {
                "dataset_id": dataset_id,
                "build_id": build_id,
                "status": "ready",
                "event": "activated",
                "schema_version": published["schema_version"],
                "render_version": published.get("render_pyramid_version", "1"),
                "activity_count": published["activity_count"],
                "at": datetime.now(UTC),
            }
        ],
    )
    point(spark, root, published)
    return published


def snapshot_legacy(
    spark: SparkSession, root: str, dataset_id: str, target_build: str, registry: str
) -> str:
    """Register the current root artifacts as the build to roll back to."""
    current = read_manifest(spark, root)
    legacy_id = check_build_id(f"legacy-before-{target_build}")
    schema = current.pop("derived_from_schema_version", current.get("schema_version"))
    current.pop("render_levels", None)
    now = datetime.now(UTC)
    legacy = {
        **current,
        "schema_version": schema,
        "build": {"id": legacy_id, "created_at": now.isoformat().replace("+00:00", "Z")},
    }
    write_text(spark, f"{build_root(root, legacy_id)}/dataset.json", json.dumps(legacy, indent=2) + "\n")
    _append(
        spark,
        registry,
        [
            {
                "dataset_id": dataset_id,
                "build_id": legacy_id,
                "status": "ready",
                "event": "built",
                "schema_version": schema,
                "activity_count": current["activity_count"],
                "at": now,
            }
        ],
    )
    return legacy_id


def active_build(registry: DataFrame) -> DataFrame:
    """Latest activation of each dataset."""
    return latest_per_key(registry.where("event = 'activated'"), ["dataset_id"], ["at", "build_id"])

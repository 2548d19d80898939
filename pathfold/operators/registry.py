"""Registry reductions: uploads, builds and datasets per user.

Tables are append-only: a later row of a key replaces the earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import top_per_key

TERMINAL = ("ready", "failed")
# Upload states in the order they are passed.
UPLOAD_STATES = (
    "uploading",
    "pending",
    "submitting",
    "queued",
    "downloading",
    "compiling",
    "publishing",
    "ready",
    "failed",
)


def stamp() -> Column:
    """When a record last changed."""
    return F.coalesce("updated_at", "created_at")


def latest_per_key(rows: DataFrame, keys: list[str], by: list[str | Column]) -> DataFrame:
    """Newest row of each key; ``by`` must order the rows of a key totally."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r"))
        .select(*keys, "r.*")
        .select(*rows.columns)
    )


def latest_ready(datasets: DataFrame) -> DataFrame:
    return latest_per_key(
        datasets.where("status = 'ready'"), ["subject"], [stamp(), "dataset_id"]
    )


def active_builds(builds: DataFrame) -> DataFrame:
    """Newest unfinished build of each dataset."""
    running = builds.where(~F.col("status").isin(*TERMINAL))
    return latest_per_key(running, ["dataset_id"], ["updated_at", "build_id"])


def upload_views(uploads: DataFrame, builds: DataFrame) -> DataFrame:
    """Uploads with the progress of a running rebuild of the same id, if there is one."""
    running = active_builds(builds).select(
        F.col("dataset_id").alias("upload_id"),
        F.col("status").alias("b_status"),
        F.col("completed").alias("b_completed"),
        F.col("total").alias("b_total"),
    )
    busy = F.col("b_status").isNotNull()

    def pick(build: str, own: str) -> Column:
        return F.when(busy, F.coalesce(build, F.lit(0))).otherwise(F.coalesce(own, F.lit(0)))

    return uploads.join(running, "upload_id", "left").select(
        "upload_id",
        "subject",
        F.coalesce("b_status", "status").alias("status"),
        pick("b_completed", "completed").alias("completed"),
        pick("b_total", "total").alias("total"),
    )


def newest(rows: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key, ranked from 1."""
    return top_per_key(rows, [key], [F.desc(c) for c in order], keep)


def user_rollup(profiles: DataFrame, uploads: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per user: counts, bytes, newest upload and the phase of the account."""
    up = uploads.groupBy("subject").agg(
        F.count(F.lit(1)).alias("uploads"),
        F.sum("byte_size").alias("uploaded_bytes"),
        F.max_by(F.struct("upload_id", "status"), F.struct(stamp(), "upload_id")).alias("last"),
    )
    ds = datasets.groupBy("subject").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("activity_count").alias("activity_count")
    )
    zero = F.lit(0)
    access = F.coalesce("access", F.lit("pending"))
    phase = (
        F.when(access != "approved", F.concat(F.lit("access:"), access))
        .when(F.col("datasets") > 0, "ready")
        .otherwise(F.coalesce("last.status", F.lit("approved")))
    )
    return (
        profiles.join(up, "subject", "left")
        .join(ds, "subject", "left")
        .select(
            "subject",
            access.alias("access"),
            phase.alias("phase"),
            F.coalesce("uploads", zero).alias("uploads"),
            F.coalesce("uploaded_bytes", zero).alias("uploaded_bytes"),
            F.col("last.upload_id").alias("latest_upload"),
            F.coalesce("datasets", zero).alias("datasets"),
            F.coalesce("activity_count", zero).alias("activity_count"),
        )
    )


def promote_uploads(uploads: DataFrame, dataset_counts: DataFrame) -> DataFrame:
    """Mark a user's oldest unfinished uploads ready while datasets outnumber ready uploads.

    Only the ready count per user and the rank among unfinished uploads are needed; the rank is
    limited by the largest number of promotions open to anyone.
    """
    c = F.col
    ready = uploads.where("status = 'ready'").groupBy("subject").agg(
        F.count(F.lit(1)).alias("ready")
    )
    room = dataset_counts.join(ready, "subject", "left").select(
        "subject", (c("datasets") - F.coalesce("ready", F.lit(0))).alias("room")
    )
    most = room.agg(F.max("room")).first()[0] or 0
    waiting = uploads.where(~c("status").isin(*TERMINAL)).select(
        "subject", "upload_id", "created_at"
    )
    oldest = [F.asc("created_at"), F.asc("upload_id")]
    chosen = (
        top_per_key(waiting, ["subject"], oldest, max(0, int(most)))
        .join(room, "subject")
        .where("rank <= room")
        .select("upload_id", F.lit(True).alias("promoted"))
    )
    return uploads.join(chosen, "upload_id", "left").select(
        *[x for x in uploads.columns if x != "status"],
        F.when(c("promoted"), "ready").otherwise(c("status")).alias("status"),
        F.coalesce("promoted", F.lit(False)).alias("promoted"),
    )


def repair_datasets(datasets: DataFrame, uploads: DataFrame) -> DataFrame:
    """Users without a ready dataset get their newest legacy one; stamps follow the upload."""
    c = F.col
    stamped = datasets.join(
        uploads.select(c("upload_id").alias("dataset_id"), c("created_at").alias("upload_at")),
        "dataset_id",
        "left",
    ).withColumn("stamp", F.coalesce("upload_at", "created_at", "updated_at"))
    ready = stamped.where("status = 'ready'")
    legacy = stamped.where("status IS NULL OR status IN ('', 'completed')").join(
        ready.select("subject"), "subject", "left_anti"
    )
    promoted = latest_per_key(legacy, ["subject"], ["stamp", "dataset_id"])
    return ready.unionByName(promoted).select(
        "subject",
        "dataset_id",
        F.lit("ready").alias("status"),
        F.coalesce("created_at", "stamp").alias("created_at"),
        c("stamp").alias("updated_at"),
    )


def stale_builds(registry: DataFrame, render_version: str) -> DataFrame:
    return registry.where(~F.col("render_version").eqNullSafe(F.lit(render_version)))


def upload_transitions(events: DataFrame) -> DataFrame:
    """(upload_id, changed_at, previous, status, allowed) of every status change of (upload_id, changed_at, status).

    An upload passes its states in order and may skip some; it may fail from any of them, and
    nothing follows ``ready`` or ``failed``.  A repeated state is no change.
    """
    order = F.array(*[F.lit(s) for s in UPLOAD_STATES])
    story = Window.partitionBy("upload_id").orderBy("changed_at", "status")  # as long as an upload's states
    told = events.withColumn("previous", F.lag("status").over(story))
    changed = told.where(~F.col("previous").eqNullSafe(F.col("status")))
    onwards = F.array_position(order, F.col("status")) > F.coalesce(F.array_position(order, F.col("previous")), F.lit(0))
    ended = F.coalesce(F.col("previous").isin(*TERMINAL), F.lit(False))
    return changed.select("upload_id", "changed_at", "previous", "status", (F.coalesce(onwards, F.lit(False)) & ~ended).alias("allowed"))


# Identifier patterns of the registry.
PATTERNS = {
    "map_id": r"(?i)^[0-9a-f-]{36}$",
    "slug": r"^[a-z0-9]{8}$",
    "subject": r"(?i)^[0-9a-f-]{16,64}$",
    "build_id": r"^[a-z0-9][a-z0-9.-]{0,79}$",
    "part_checksum": r"^[A-Za-z0-9+/]{43}=$",
}
MAX_UPLOAD_BYTES = 5_000_000_000


def matches(column, pattern: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.rlike(PATTERNS[pattern]), F.lit(False))


def valid_upload(filename, size) -> Column:
    name, size = F.col(filename), F.col(size)
    return F.lower(name).endswith(".zip") & (size > 0) & (size <= MAX_UPLOAD_BYTES)

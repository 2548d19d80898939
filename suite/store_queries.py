"""Datasets that are really written: an archive of files, a store of base and delta builds, its readers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pathfold.operators import selection as sel
from pathfold.plans import increments
from pathfold.plans.compile import ArchiveAdapter
from pathfold.plans.paths import qualified
from pathfold.session import scratch_path
from pathfold.sources import archive
from pathfold.sources import dataset as ds
from pathfold.sources.event_tracks import SPORTS
from pathfold.sources.files import open_uri

from .base import POINTS, activities, points, q, rounded, with_activities
from .registry_queries import FILE_POINTS, element, track_files
from .select_queries import BOX, sql_intersects

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def track_texts(spark: SparkSession, d: str) -> DataFrame:
    """(file_name, text, user, late) of the derived tracks as GPX; those of odd weeks come late."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.format_string('<trkpt lat="%s" lon="%s">', F.col("lat").cast("string"), F.col("lon").cast("string"))
    point = F.concat(place, element("ele", F.col("ele")), element("time", when), F.lit("</trkpt>"))
    ids = F.split(F.substring_index("file", "#", 1), "-")
    whole = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'), "body", F.lit("</trkseg></trk></gpx>"))
    return track_files(spark, d, point).select(
        F.concat(F.replace("file", F.lit("#"), F.lit(".")), F.lit(".gpx")).alias("file_name"),
        whole.alias("text"),
        ids[0].cast("long").alias("user"),
        (F.pmod(ids[1].cast("long"), F.lit(2)) == 1).alias("late"),
    )


def write_texts(texts: DataFrame, folder: str) -> None:
    """A file for each (file_name, text), written by tasks."""
    target = qualified(texts.sparkSession, folder)

    def run(batches):
        fs, base = open_uri(target)
        fs.create_dir(base)
        for batch in batches:
            for name, text in zip(batch["file_name"], batch["text"]):
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    texts.select("file_name", "text").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_table(texts: DataFrame, root: str) -> None:
    """The archive's table: a row for each file, and one for each user whose file is not there."""
    sport = F.element_at(F.array(*[F.lit(s) for s in SPORTS]), (F.col("user") % 6 + 1).cast("int"))
    there = texts.select(F.regexp_replace("file_name", r"\.gpx$", "").alias("id"), "user", F.concat(F.lit("activities/"), "file_name").alias("file"))
    lost = texts.select("user").distinct().select(F.concat(F.lit("lost-"), "user").alias("id"), "user", F.concat(F.lit("lost-"), "user", F.lit(".gpx")).alias("file"))
    there.unionByName(lost).select(
        F.col("id").alias("Activity ID"),
        F.lit("Jan 02, 2024, 03:04:05 AM").alias("Activity Date"),
        F.concat(F.lit('Track "'), "id", F.lit('", and more')).alias("Activity Name"),
        sport.alias("Activity Type"),
        (F.col("user") % 50).cast("string").alias("Distance"),
        F.col("file").alias("Filename"),
    ).write.option("header", True).option("escape", '"').csv(f"{root}/activities.csv")


ARCHIVES: dict[tuple[str, str], str] = {}
MADE: dict[tuple[str, str], tuple[str, str]] = {}


def dealt_texts(spark: SparkSession, d: str) -> DataFrame:
    # Few bytes, but a file a row, so the planner's sizes do not decide the number of tasks.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return track_texts(spark, d).repartition(tasks, "file_name").persist()


def archived(spark: SparkSession, d: str) -> str:
    """The whole archive of these tables, made once a session; that of the store, where one was made."""
    key = (spark.sparkContext.applicationId, d)
    if key in MADE:
        return MADE[key][0]
    if key not in ARCHIVES:
        root = f"{scratch_path(spark, 'archived')}/archive"
        texts = dealt_texts(spark, d)
        write_table(texts, root)
        write_texts(texts, f"{root}/activities")
        texts.unpersist()
        ARCHIVES[key] = root
    return ARCHIVES[key]


def written(spark: SparkSession, d: str) -> tuple[str, str]:
    """(archive, store) of these tables, made once a session: a base of the even weeks, then the rest appended."""
    key = (spark.sparkContext.applicationId, d)
    if key not in MADE:
        root = scratch_path(spark, "grown")
        texts = dealt_texts(spark, d)
        adapter = ArchiveAdapter(f"{root}/archive")
        write_table(texts, adapter.root)
        write_texts(texts.where("NOT late"), f"{adapter.root}/activities")
        increments.start_store(spark, adapter, f"{root}/store")
        write_texts(texts.where("late"), f"{adapter.root}/activities")
        texts.unpersist()
        increments.append(spark, adapter, f"{root}/store", max_files=100_000)
        MADE[key] = (adapter.root, f"{root}/store")
    return MADE[key]


FILES = f"""WITH {POINTS},
files AS (SELECT activity_id || '.' || (seq // {FILE_POINTS}) AS id, any_value(u) AS u, count(*) AS point_count, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax,
    count(ele) AS elevations, arg_min(lon, seq) AS first_lon, arg_max(lat, seq) AS last_lat FROM pts GROUP BY 1),
stored AS (SELECT *, list_extract(['run', 'run', 'ride', 'foot', 'water', 'other'], CAST(u % 6 + 1 AS BIGINT)) AS activity_family FROM files WHERE point_count >= 2)"""
BOUNDS = ", ".join(f"{q(b, 5)} AS {b}" for b in ("xmin", "ymin", "xmax", "ymax"))


@register("incremental_compile", f"{FILES} SELECT id AS activity_id, activity_family, point_count, {BOUNDS} FROM stored")
def _(spark, d):
    """Metadata of a base build and a delta of files that came later: that of all files."""
    rows = ds.scan_metadata(spark, written(spark, d)[1])
    return rounded(rows.select("activity_id", "activity_family", "point_count", "xmin", "ymin", "xmax", "ymax"), 5)


@register(
    "store_rejections",
    f"""{FILES} SELECT 'missing_file' AS reason_code, 'discovery' AS stage, count(DISTINCT u) AS n FROM files
      UNION ALL SELECT 'ValueError', 'parse', count(*) FROM files WHERE point_count < 2 HAVING count(*) > 0""",
)
def _(spark, d):
    rows = ds.scan_rejections(spark, written(spark, d)[1])
    return rows.groupBy("reason_code", "stage").agg(F.count(F.lit(1)).alias("n"))


@register(
    "store_lines",
    f"{FILES} SELECT id AS activity_id, activity_family, point_count AS points, elevations, {q('first_lon', 5)} AS first_lon, {q('last_lat', 5)} AS last_lat FROM stored",
)
def _(spark, d):
    """Every shard of base and delta, by the files that the version lists."""
    track = F.col("track_points")
    rows = ds.scan_canonical(spark, written(spark, d)[1]).select("activity_id", "activity_family", "part", "geometry", F.size(track).alias("n"), F.size(F.filter(track, lambda p: p["elevation_m"].isNotNull())).alias("e"))
    ends = rows.groupBy("activity_id", "activity_family").agg(
        F.sum("n").cast("long").alias("points"), F.sum("e").cast("long").alias("elevations"),
        F.min_by(F.get("geometry", F.lit(0))[0], "part").alias("first_lon"), F.max_by(F.get("geometry", F.size("geometry") - 1)[1], "part").alias("last_lat"),
    )
    return rounded(ends, 5)


@register(
    "viewport_read",
    f"""{FILES} SELECT lod, count(*) AS kept_rows, CAST(sum(CASE WHEN lod = 7 THEN point_count ELSE 0 END) AS BIGINT) AS full_vertices, true AS reads_enough, true AS reads_no_more
      FROM stored, range(8) t(lod) WHERE {sql_intersects(BOX)} GROUP BY lod""",
)
def _(spark, d):
    """A viewport read of all levels from the row groups that meet it, with what was read of the files."""
    store = written(spark, d)[1]
    seen = Observation("viewport")
    rows = ds.scan_render(spark, store, None, BOX, seen=seen).groupBy("lod").agg(
        F.count(F.lit(1)).alias("kept_rows"), F.sum(F.when(F.col("lod") == 7, F.col("vertex_count")).otherwise(0)).alias("full_vertices")
    )
    kept = rows.collect()  # a row a level
    read = seen.get
    groups = [spark.read.parquet(f"{f}/manifest").where("kind = 'render'") for f in ds.version_of(spark, store).folders["render"]]
    total = sum(g.agg(F.sum("row_count")).first()[0] for g in groups)
    enough, no_more = sum(r.kept_rows for r in kept) <= read["rows"], read["rows"] <= total
    out = spark.createDataFrame([(r.lod, r.kept_rows, r.full_vertices, enough, no_more) for r in kept], "lod long, kept_rows long, full_vertices long, reads_enough boolean, reads_no_more boolean")
    return out


@register(
    "archive_rows",
    f"""{FILES}, every AS (SELECT id, u FROM files UNION ALL SELECT DISTINCT 'lost-' || u, u FROM files)
      SELECT id AS source_activity_id, 'Track "' || id || '", and more' AS name,
        list_extract(['Run', 'Trail Run', 'Ride', 'Walk', 'Kayaking', 'Workout'], CAST(u % 6 + 1 AS BIGINT)) AS sport_type, (u % 50) * 1000.0 :: DOUBLE AS distance_csv FROM every""",
)
def _(spark, d):
    """The archive's table, read by headings."""
    rows = archive.read_activity_csv(spark, f"{archived(spark, d)}/activities.csv")
    return rows.select("source_activity_id", "name", "sport_type", "distance_csv")


@register("archive_files", f"{FILES} SELECT id || '.gpx' AS file_name, true AS sized, true AS summed FROM files")
def _(spark, d):
    """The files that lie in the archive, their sizes and checksums those of the texts."""
    folder = f"{archived(spark, d)}/activities"
    found = archive.list_activity_files(spark, folder).join(archive.file_sha256(spark, folder), "file_name")
    told = track_texts(spark, d).select("file_name", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sum"))
    return found.join(told, "file_name").select("file_name", (F.col("byte_size") == F.col("size")).alias("sized"), (F.col("source_checksum") == F.col("sum")).alias("summed"))


@register(
    "route_metadata",
    with_activities(f"SELECT activity_id, name, sport_type, {q('distance_m', 1)} AS distance_m FROM activities WHERE activity_id = (SELECT max(activity_id) FROM activities)"),
)
def _(spark, d):
    """Metadata of one activity, by its id."""
    rows = activities(spark, d)
    last = points(spark, d).groupBy("activity_id").count().where("count >= 2").agg(F.max("activity_id")).first()[0]
    return rounded(sel.route_metadata(rows, last).select("activity_id", "name", "sport_type", "distance_m"), 1)

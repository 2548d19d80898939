import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pathfold.plans import builds, increments, paths, writers
from pathfold.plans.compile import ArchiveAdapter, CompileOptions, compile_dataset, rebuild_derived, validate_dataset
from pathfold.plans.dataset_session import DatasetSession
from pathfold.sources import dataset as ds
from pathfold.sources.archive import list_activity_files

from .conftest import WALK, gpx_text

LATER = [(46.5 + i / 1000, 8.0 + i / 1000, 400 + i, f"2024-07-01T08:{i:02}:00Z") for i in range(5)]


def grow(archive, number, points=None, text=None):
    """A row for an activity, and its file where there are points or a text."""
    with open(archive / "activities.csv", "a") as handle:
        handle.write(f'{number},"Jul 01, 2024, 08:00:00 AM",New,Run,80,2,80,80,2,0,activities/{number}.gpx\n')
    if points or text:
        (archive / "activities" / f"{number}.gpx").write_text(text or gpx_text(points))


def facts(df, drop=("canonical_path", "canonical_row_group")):
    return sorted(map(repr, df.drop(*drop).collect()))


def test_base_and_deltas_equal_a_full_compile(spark, archive, tmp_path):
    store, adapter = f"{tmp_path}/store", ArchiveAdapter(str(archive))
    increments.start_store(spark, adapter, store)
    assert increments.append(spark, adapter, store) == []
    grow(archive, 601, LATER)
    grow(archive, 602, text="<gpx><broken")
    grow(archive, 603, [(y, x + 1, e, t) for y, x, e, t in WALK])
    checkpoint = f"{tmp_path}/state"
    increments.watch(spark, adapter, store, checkpoint).awaitTermination(300)
    pointer = (tmp_path / "store" / "dataset.json").read_text()
    increments.watch(spark, adapter, store, checkpoint).awaitTermination(300)
    assert increments.append(spark, adapter, store) == []  # a batch that comes again
    assert (tmp_path / "store" / "dataset.json").read_text() == pointer
    grow(archive, 604, text="<gpx></gpx>")  # a build of one rejection
    first = json.loads(pointer)["build"]["id"]
    assert len(increments.append(spark, adapter, store)) == 1

    whole = f"{tmp_path}/whole"
    full = compile_dataset(spark, adapter, whole)
    version = ds.read_manifest(spark, store)
    for name in ("activity_count", "rejection_count", "bbox", "first_activity", "last_activity", "source_counts"):
        assert version[name] == full[name], name
    assert [v["row_count"] for v in version["render_levels"]] == [v["row_count"] for v in full["render_levels"]]
    assert len(version["parts"]) == 3 and version["parts"][-1]["kinds"] == ["rejections"]
    for read in (ds.scan_metadata, ds.scan_canonical, ds.scan_rejections, ds.scan_render):
        assert facts(read(spark, store)) == facts(read(spark, whole)), read
    validate_dataset(spark, store)

    with_deltas = DatasetSession(spark, store)
    assert with_deltas.count() == 4 and with_deltas.activity_detail("601").first().path == [[x, y] for y, x, *_ in LATER]
    with_deltas.close()
    located = ds.scan_metadata(spark, store).where("activity_id = '601'").first()
    assert ds.scan_canonical_file(spark, store, located.canonical_path).first().activity_id == "601"

    # New metadata and levels over the shards of base and delta, which stay where they are.
    before = {r.path: r.sha256 for r in writers.manifest_files(spark, store).where("kind = 'activities'").collect()}
    rebuild_derived(spark, store, f"{store}/builds/fresh")
    registry = f"{tmp_path}/registry"
    builds.publish_build(spark, store, "d", "fresh", registry)
    after = {r.path: r.sha256 for r in writers.manifest_files(spark, store).where("kind = 'activities'").collect()}
    assert before == after and not (tmp_path / "store" / "builds" / "fresh" / "activities").exists()
    assert facts(ds.scan_metadata(spark, store)) == facts(ds.scan_metadata(spark, whole))
    validate_dataset(spark, store)
    stray = tmp_path / "store" / "builds" / "base" / "render" / "lod=0" / "left-behind.parquet"
    stray.write_bytes(b"half")
    assert ds.scan_render(spark, store).count() == 32
    removed = increments.clean_store(spark, store, keep=("base", first))
    assert removed == 1 and not stray.exists()
    builds.rollback(spark, store, "d", first, registry)
    assert DatasetSession(spark, store).count() == 4
    builds.rollback(spark, store, "d", "base", registry)
    assert DatasetSession(spark, store).count() == 2
    assert increments.clean_store(spark, store) > 0
    assert ds.scan_canonical(spark, store).count() == 2


def test_an_activity_under_another_file_is_refused(spark, archive, tmp_path):
    store, adapter = f"{tmp_path}/store", ArchiveAdapter(str(archive))
    increments.start_store(spark, adapter, store)
    with open(archive / "activities.csv", "a") as handle:
        handle.write('501,"Jul 01, 2024, 08:00:00 AM",Twice,Run,80,2,80,80,2,0,activities/701.gpx\n')
    (archive / "activities" / "701.gpx").write_text(gpx_text(LATER))
    with pytest.raises(ValueError, match="another file"):
        increments.append(spark, adapter, store)
    assert DatasetSession(spark, store).count() == 2


def test_overwrite_keeps_the_old_output_until_the_new_one_is_there(spark, archive, tmp_path, monkeypatch):
    out, adapter = f"{tmp_path}/out", ArchiveAdapter(str(archive))
    compile_dataset(spark, adapter, out)
    grow(archive, 601, LATER)
    real, calls = paths.rename, []

    def failing(spark, source, target):
        calls.append(target)
        if ".building-" in source:
            raise OSError("the store is gone")
        real(spark, source, target)

    monkeypatch.setattr(paths, "rename", failing)
    with pytest.raises(OSError, match="gone"):
        compile_dataset(spark, adapter, out, CompileOptions(overwrite=True))
    assert len(calls) == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["archive", "out"]
    assert DatasetSession(spark, out).count() == 2
    monkeypatch.undo()
    compile_dataset(spark, adapter, out, CompileOptions(overwrite=True))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["archive", "out"] and DatasetSession(spark, out).count() == 3


def test_viewport_opens_only_the_groups_it_meets(spark, archive, tmp_path):
    grow(archive, 601, LATER)
    out = f"{tmp_path}/out"
    compile_dataset(spark, ArchiveAdapter(str(archive)), out)
    box, seen = (7.99, 46.4, 8.1, 46.6), Observation("read")
    want = facts(ds.scan_render(spark, out).where("activity_id = '601' AND lod = 7"))
    manifest = spark.read.parquet(f"{out}/manifest").where("kind = 'render' AND lod = 7 AND xmax >= 7.99")
    other = tmp_path / "out" / "render"
    for level in other.glob("lod=[0-6]"):
        for file in level.glob("*.parquet"):
            file.write_bytes(b"never opened")
    assert facts(ds.scan_render(spark, out, 7, box, seen=seen)) == want
    assert seen.get == {"files": 1, "row_groups": manifest.count(), "rows": manifest.agg(F.sum("row_count")).first()[0]}
    none = Observation("none")
    assert ds.scan_render(spark, out, 7, (100, 0, 101, 1), seen=none).count() == 0 and none.get["files"] == 0


ATTEMPT = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from pathfold.plans.writers import write_geo
from pathfold.sources.dataset import scan
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def fails_once(batches):
    for k, batch in enumerate(batches):
        yield batch
        if k == 1 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")

i = F.col("id")
rows = spark.range(0, 4000, 1, 1).select(
    *[(i / 10).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")], F.array(F.array(i / 10, i / 20)).alias("geometry"), F.lit("run").alias("family"))
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
path = sys.argv[1]
write_geo(rows.mapInArrow(fails_once, rows.schema), path + "/activities", partition="family", group_rows=100, file_rows=500)
assert scan(spark, [path], "activities").count() == 4000
"""


def test_a_failed_attempt_leaves_no_visible_rows(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", ATTEMPT, str(tmp_path)], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    written = list((tmp_path / "activities" / "family=run").glob("*.parquet"))
    (listed,) = (tmp_path / "activities" / "_files").glob("*.txt")
    names = listed.read_text().split()
    assert len(names) == 8 and {f"family=run/{f.name}" for f in written} >= set(names)
    assert len({n.split("-")[3] for n in names}) == 1  # one attempt's files


def test_named_files_are_read_by_few_tasks(spark, archive):
    """A table of names, not a list of paths: no listing job with a task a path, and other files stay closed."""
    folder = archive / "activities"
    names = tuple(f"many-{i:02}.GPX" for i in range(60))
    for name in names:
        (folder / name).write_text(gpx_text(WALK))
    (folder / "damaged.tcx.gz").write_bytes(b"not packed")
    (folder / ".hidden.gpx").write_text("")
    rows = "".join(f'{n},"Jun 09, 2024, 07:10:00 AM",Many,Hike,300,0.9,271,268,0.8,24,activities/{n}\n' for n in names)
    with open(archive / "activities.csv", "a") as table:
        table.write(rows)
    adapter = ArchiveAdapter(str(archive), only=(*names, "502.tcx.gz"))
    spark.sparkContext.setJobGroup("named", "named files")
    try:
        records, _ = adapter.records(spark)
        points = adapter.points(spark, records).groupBy("activity_id").count().collect()
        sums = {r.file_name: r.source_checksum for r in records.collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.activity_id: r["count"] for r in points} == {n: 6 for n in names} | {"502.tcx.gz": 3}
    assert sums == {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in (*names, "502.tcx.gz")}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("named") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) < len(names)
    listed = {r.file_name for r in list_activity_files(spark, str(folder)).collect()}
    assert listed == {*names, "501.gpx", "502.tcx.gz", "damaged.tcx.gz"}


def test_archive_queries_need_no_store(spark, monkeypatch):
    """Listing an archive and reading its table compile nothing; the whole archive is there."""
    from suite import store_queries

    def refuse(*args, **options):
        raise AssertionError("a store is compiled")

    monkeypatch.setattr(store_queries, "MADE", {})
    monkeypatch.setattr(store_queries, "ARCHIVES", {})
    monkeypatch.setattr(increments, "start_store", refuse)
    found = store_queries.QUERIES["archive_files"](spark, "/root/testdata/sf0.001").collect()
    names = store_queries.track_texts(spark, "/root/testdata/sf0.001").select("file_name").collect()
    assert sorted(r.file_name for r in found) == sorted(r.file_name for r in names)
    assert all(r.sized and r.summed for r in found)
    assert store_queries.QUERIES["archive_rows"](spark, "/root/testdata/sf0.001").count() > len(found)


def test_an_append_of_several_builds_lists_the_archive_once(spark, archive, tmp_path, monkeypatch):
    """One listing for all builds of an append, one that finds nothing new; the rows are those of a full compile."""
    from pathfold.sources import archive as source

    store, adapter = f"{tmp_path}/store", ArchiveAdapter(str(archive))
    increments.start_store(spark, adapter, store)
    for number in (601, 602, 603):
        grow(archive, number, [(y, x + number / 100, e, t) for y, x, e, t in WALK])
    (archive / "activities" / "604.gpx").write_text(gpx_text(LATER))  # no row names it
    listings, real = [], source.list_activity_files

    def counted(*args):
        listings.append(args)
        return real(*args)

    monkeypatch.setattr(source, "list_activity_files", counted)
    made = increments.append(spark, adapter, store, max_files=1)
    assert len(made) == 3 and len(listings) == 2
    monkeypatch.undo()
    whole = f"{tmp_path}/whole"
    full = compile_dataset(spark, adapter, whole)
    version = ds.read_manifest(spark, store)
    for name in ("activity_count", "rejection_count", "bbox", "source_counts"):
        assert version[name] == full[name], name
    for read in (ds.scan_metadata, ds.scan_canonical, ds.scan_rejections, ds.scan_render):
        assert facts(read(spark, store)) == facts(read(spark, whole)), read


def test_files_of_a_compile_are_read_in_one_round_of_tasks(spark, archive, tmp_path):
    """Both readers share a pass over the files, and the kinds of a build one over theirs."""
    from pathfold.sources.files import _uris, dealt

    records, _ = ArchiveAdapter(str(archive)).records(spark)
    points = ArchiveAdapter(str(archive)).points(spark, records)
    tasks = dealt(records.select("file_name"), "file_name").rdd.getNumPartitions()
    assert points.rdd.getNumPartitions() == tasks
    assert {r.activity_id for r in points.select("activity_id").distinct().collect()} == {"501.gpx", "502.tcx.gz"}
    compile_dataset(spark, ArchiveAdapter(str(archive)), f"{tmp_path}/out")
    kinds = ("activities", "metadata", "render")
    uris = _uris(spark, f"{tmp_path}/out", kinds)
    assert uris.rdd.getNumPartitions() == tasks and {r.kind for r in uris.collect()} == set(kinds)

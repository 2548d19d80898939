import json
import shutil

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pathfold.plans import builds, writers
from pathfold.plans import render as rn
from pathfold.plans.compile import (
    ArchiveAdapter,
    CompileOptions,
    check_rejections,
    compile_dataset,
    rebuild_derived,
    validate_dataset,
)
from pathfold.plans.dataset_session import DatasetSession
from pathfold.sources import archive as ar

from .conftest import WALK


def test_csv_second_occurrence_wins(spark, archive):
    rows = {r.source_activity_id: r for r in ar.read_activity_csv(spark, f"{archive}/activities.csv").collect()}
    assert rows["501"].distance_csv == 800
    assert rows["501"].elapsed_csv == 271
    assert rows["501"].name == 'Along the river, "twice"'
    assert rows["501"].start_text == "Jun 09, 2024, 07:10:00 AM"
    assert set(rows) == {"501", "502", "503"}


def test_matching_rejects_missing_and_unmatched(spark, archive):
    (archive / "activities" / "extra.gpx").write_text("<gpx/>")
    (archive / "activities" / "note.txt").write_text("x")
    rows = ar.read_activity_csv(spark, f"{archive}/activities.csv")
    files = ar.list_activity_files(spark, f"{archive}/activities")
    records, rejects = ar.match_files(rows, files)
    assert {r.file_name for r in records.collect()} == {"501.gpx", "502.tcx.gz"}
    found = {(r.source_path, r.reason_code) for r in rejects.collect()}
    assert found == {
        ("503.gpx.gz", "missing_file"),
        ("extra.gpx", "unmatched_file"),
        ("note.txt", "unmatched_file"),
    }


def test_readers(spark, archive):
    gpx = ar.read_gpx(spark, f"{archive}/activities").orderBy("seq").collect()
    assert [(p.seq, p.lat, p.lon, p.ele) for p in gpx] == [(i, *p[:3]) for i, p in enumerate(WALK)]
    tcx = ar.read_tcx(spark, f"{archive}/activities").orderBy("seq").collect()
    assert [(p.seq, p.lat, p.ele, p.hr) for p in tcx] == [(0, 46.9, 510, None), (1, 46.905, None, None), (2, 46.91, 515, 131)]
    assert tcx[2].ts.isoformat() == "2024-06-10T16:04:00"


def test_compile_validate_rebuild_publish(spark, archive, tmp_path):
    (archive / "activities" / "504.gpx").write_text("<gpx><broken")
    with open(archive / "activities.csv", "a") as handle:
        handle.write('504,"Jun 12, 2024, 10:00:00 AM",Torn,Run,80,2,80,80,2,0,activities/504.gpx\n')
    out = f"{tmp_path}/out"
    progress = Observation("compiled")
    manifest = compile_dataset(spark, ArchiveAdapter(str(archive)), out, progress=progress)
    assert progress.get["completed"] == 2
    assert manifest["activity_count"] == 2
    assert manifest["rejection_count"] == 2
    assert manifest["bbox"] == [7.4, 46.9, 7.45, 46.9545]
    assert [v["lod"] for v in manifest["render_levels"]] == list(range(8))
    assert manifest["source_counts"] == {"gpx": 1, "tcx": 1}
    rejects = {(r.source_path, r.reason_code) for r in spark.read.parquet(f"{out}/rejections").collect()}
    assert rejects == {("503.gpx.gz", "missing_file"), ("504.gpx", "ValueError")}
    meta = {r.activity_id: r for r in spark.read.parquet(f"{out}/metadata").collect()}
    assert meta["501"].canonical_path.startswith("activities/activity_family=foot/")
    assert meta["501"].canonical_row_group == 0
    assert meta["501"].elevation_gain_m == 32 and meta["501"].elevation_loss_m == 6
    assert meta["501"].moving_seconds == 268 and meta["501"].moving_time_source == "csv"
    assert meta["502"].activity_family == "ride" and meta["502"].source_type == "tcx"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["archive", "out"]  # nothing staged is left
    files = writers.manifest_files(spark, out)
    assert files.where("kind = 'render'").count() >= 8 and files.count() == spark.read.parquet(f"{out}/manifest").select("path").distinct().count()
    with pytest.raises(FileExistsError):
        compile_dataset(spark, ArchiveAdapter(str(archive)), out)
    with pytest.raises(ValueError, match="rows rejected"):
        check_rejections(manifest, CompileOptions(max_rejections=1))
    with pytest.raises(ValueError, match="a share of"):
        check_rejections(manifest, CompileOptions(max_rejection_rate=0.4))
    check_rejections(manifest, CompileOptions(max_rejections=2, max_rejection_rate=0.5))

    store = tmp_path / "store"
    rebuilt = rebuild_derived(spark, out, f"{store}/builds/b1")
    assert rebuilt["derived_from_schema_version"] == "1.6.0"
    shutil.copytree(store / "builds" / "b1", store / "builds" / "b2")
    registry = f"{tmp_path}/registry"
    builds.publish_build(spark, str(store), "d", "b1", registry, "u")
    builds.publish_build(spark, str(store), "d", "b2", registry, "u")
    pointer = json.loads((store / "dataset.json").read_text())
    assert pointer["build"]["id"] == "b2"
    assert all(r.path.startswith("builds/b2/") for r in writers.manifest_files(spark, str(store)).collect())
    session = DatasetSession(spark, str(store))
    assert session.root.endswith("/builds/b2") and session.count() == 2
    session.close()
    builds.rollback(spark, str(store), "d", "b1", registry)
    assert json.loads((store / "dataset.json").read_text())["build"]["id"] == "b1"
    assert DatasetSession(spark, str(store)).root.endswith("/builds/b1")
    assert not list(store.glob("*.new")) and builds.active_build(spark.read.parquet(registry)).first().build_id == "b1"
    assert builds.snapshot_legacy(spark, out, "d", "next", registry) == "legacy-before-next"

    shard = next((tmp_path / "out" / "activities").rglob("*.parquet"))
    shard.write_bytes(shard.read_bytes() + b"x")
    for crc in shard.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        validate_dataset(spark, out)
    with pytest.raises(ValueError):
        builds.check_build_id("Bad Id")


def test_long_track_splits_into_parts(spark, archive, tmp_path):
    whole = compile_dataset(spark, ArchiveAdapter(str(archive)), f"{tmp_path}/a")
    split = compile_dataset(
        spark, ArchiveAdapter(str(archive)), f"{tmp_path}/b", CompileOptions(chunk_points=2)
    )
    assert whole["activity_count"] == split["activity_count"] == 2
    drop = ["canonical_path", "canonical_row_group"]
    a = spark.read.parquet(f"{tmp_path}/a/metadata").drop(*drop)
    b = spark.read.parquet(f"{tmp_path}/b/metadata").drop(*drop)
    a = a.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])
    b = b.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes])
    assert a.exceptAll(b).count() == 0
    assert spark.read.parquet(f"{tmp_path}/b/activities").where("part > 0").count() == 3
    # The parts of a track are one route at every level.
    for root in ("a", "b"):
        spark.read.parquet(f"{tmp_path}/{root}/render").createOrReplaceTempView(root)
    totals = "SELECT activity_id, lod, sum(vertex_count) AS n, sum(clean_vertex_count) AS m FROM {} GROUP BY 1, 2"
    assert spark.sql(totals.format("a")).exceptAll(spark.sql(totals.format("b"))).count() == 0
    for lod in range(8):
        drawn = []
        for root in ("a", "b"):
            lines = rn.fetch_lines(spark.table(root).where(f"lod = {lod}"))
            pieces = rn.line_segments(lines)
            legs = {
                (r.activity_id, tuple(p), tuple(q))
                for r in pieces.collect()
                for p, q in zip(r.positions, r.positions[1:])
            }
            drawn.append((legs, pieces.where("NOT continues").count()))
        assert drawn[0] == drawn[1]
    detail = DatasetSession(spark, f"{tmp_path}/b").activity_detail("501").orderBy("part").collect()
    assert [tuple(p) for r in detail for p in r.path] == [(x, y) for y, x, *_ in WALK]


def test_archive_entry_rules(spark):
    ok = [("activities.csv", 10), ("activities/1.gpx", 20), ("notes.txt", 5), ("activities/", 0)]
    frame = spark.createDataFrame(ok, "name string, byte_size long")
    assert ar.filter_archive_entries(frame).count() == 2
    schema = "name string, byte_size long"
    for bad in ([*ok, ("../x", 1)], [*ok, ("/etc/x", 1)], ok[:1]):
        with pytest.raises(ValueError):
            ar.filter_archive_entries(spark.createDataFrame(bad, schema))
    large = spark.createDataFrame([*ok, ("activities/2.gpx", 2 * 10**10)], schema)
    assert ar.filter_archive_entries(large).count() == 3  # no limit of its own
    for limits in ((2, None, None), (None, 10**9, None), (None, None, 10**10)):
        with pytest.raises(ValueError):
            ar.filter_archive_entries(large, *limits)

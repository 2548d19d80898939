import pytest
from pyspark.sql import functions as F

from pathfold.plans.compile import ArchiveAdapter, compile_dataset
from pathfold.plans.dataset_session import DatasetSession, SelectionSpec
from pathfold.plans.layout_trial import compare_layouts
from pathfold.plans.writers import read_manifest
from pathfold.sources import dataset as ds

from .conftest import WALK


def test_session_over_a_compiled_dataset(spark, archive, tmp_path):
    root = f"{tmp_path}/out"
    compile_dataset(spark, ArchiveAdapter(str(archive)), root)
    session = DatasetSession(spark, root)
    assert session.execute(SelectionSpec()) is None and session.count() == 2
    total = session.summary().first()
    assert total.activity_count == 2 and total.elevation_gain_m == 37
    assert [r.sport for r in session.family_counts().collect()] == ["foot", "ride"]

    spec = SelectionSpec("SELECT activity_id, sport_type, point_count FROM activities WHERE point_count > 3;")
    assert [r.activity_id for r in session.execute(spec).collect()] == ["501"]
    assert session.count() == 1
    assert {r.dimension for r in session.dimensions.collect()} == {"sport_type", "point_count"}
    assert session.table((7, 46, 8, 47)).count() == 1
    assert session.table((7.442, 46, 8, 47)).count() == 0  # containment, not intersection
    telemetry = SelectionSpec(
        "SELECT activity_id FROM activities_full WHERE exists(track_points, p -> p.heart_rate >= 120)"
    )
    assert [r.activity_id for r in session.execute(telemetry).collect()] == ["502"]
    box = [(7.43, 46.9525), (7.46, 46.9525), (7.46, 46.96), (7.43, 46.96)]
    spatial = SelectionSpec(clean=True, polygon=box)
    assert [r.activity_id for r in session.execute(spatial).collect()] == ["501"]
    detail = session.activity_detail("501").first()
    assert detail.path == [[x, y] for y, x, *_ in WALK]
    profile = session.elevation_profile("501").orderBy("seq").collect()
    assert [p.ele for p in profile] == [540, 552, 549, 561, 558, 566] and profile[0].distance_m == 0
    assert session.activity_detail("nope") is None
    assert session.route_metadata("502").first().name == "Home"

    view = session.render(18.0, (7, 46, 8, 47))
    assert view.plan.lod == 7 and view.plan.vertices == 6 and view.candidate_routes == 1
    assert set(view.resolutions) == {"low", "medium", "high"}
    assert [len(r.positions) for r in view.segments.collect()] == [6]
    assert session.render(18.0, (10, 10, 11, 11)).segments.count() == 0
    spark.range(1).selectExpr("'501' AS activity_id").createOrReplaceGlobalTempView("seen")
    fine = "WITH long AS (SELECT activity_id FROM activities WHERE point_count > 3) SELECT activity_id FROM long"
    assert session.execute(SelectionSpec(fine)).count() == 1
    for bad in ("SELECT * FROM parquet.`/tmp/x`", "SELECT activity_id FROM other", "DROP VIEW activities", "SELECT reflect('java.lang.System', 'currentTimeMillis') AS activity_id", "SELECT activity_id FROM global_temp.seen", "SELECT activity_id FROM activities WHERE EXISTS (SELECT 1 FROM global_temp.seen)", "WITH x AS (SELECT java_method('java.lang.Math', 'random') AS activity_id) SELECT * FROM x"):
        with pytest.raises(Exception):
            session.execute(SelectionSpec(bad))
    session.close()

    path = spark.read.parquet(f"{root}/metadata").first().canonical_path
    assert ds.scan_canonical_file(spark, root, path).count() == 1
    assert ds.locate([f"b/{path}", "x/y.parquet"], f"/{path}") == f"b/{path}"
    with pytest.raises(ValueError):
        ds.locate([], path)
    with pytest.raises(ValueError):
        ds.locate([f"a/{path}", f"b/{path}"], path)
    with pytest.raises(ValueError):
        ds.family_of("part-0.parquet")
    found = ds.discover_datasets(spark, f"{tmp_path}/*/dataset.json").collect()
    assert [(r.schema_version, r.activity_count) for r in found] == [("1.6.0", 2)]
    geo = read_manifest(spark, root)["geo"]
    assert geo["columns"]["geometry_clean"]["covering"]["bbox"]["xmin"] == ["clean_xmin"]
    level = spark.read.parquet(f"{root}/render").where("lod = 7")
    trials = compare_layouts(spark, level.drop("geometry", "geometry_clean"), f"{tmp_path}/trial", sizes=(128,), repeats=1)
    assert [t["ordered"] for t in trials] == [True, False] and all(t["minimum_ms"] > 0 for t in trials)
    assert level.where(F.size("geometry") != F.col("vertex_count")).count() == 0


@pytest.mark.parametrize("tasks", [12, 9])
def test_files_are_dealt_to_all_tasks(spark, tmp_path, tasks):
    """Names that are distinct already are not joined to one task for their few bytes."""
    from pathfold.sources import folders

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        for n in range(60):
            (tmp_path / f"{n}.gpx").write_text(f"<gpx>{n}</gpx>")
        names = spark.range(60).select(F.concat(F.col("id").cast("string"), F.lit(".gpx")).alias("file_name"))
        read = folders.texts(names, f"file:{tmp_path}").withColumn("task", F.spark_partition_id())
        assert read.select("task").distinct().count() > tasks // 2 and read.count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

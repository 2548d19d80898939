from pyspark.sql import functions as F

from pathfold.operators import tracks as tr
from pathfold.plans import writers
from suite import base
from suite.registry_queries import write_shards

SF = "/root/testdata/sf0.001"


def canonical_rows(spark, chunk_points=tr.CHUNK_POINTS):
    flagged = tr.clean_track(base.points(spark, SF), chunk_points)
    return tr.track_parts(flagged).join(base.activities(spark, SF), "activity_id")


def same_rows(a, b):
    names = sorted(a.columns)
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_shards_are_the_same_without_lines_to_begin_with(spark, tmp_path):
    """The lines are made of the points after the range shuffle, whose sampling pass would make them too."""
    rows = canonical_rows(spark)
    writers.write_canonical(rows, f"{tmp_path}/lines")
    writers.write_canonical(rows.drop("geometry", "geometry_clean"), f"{tmp_path}/points")
    write_shards(spark, SF, f"{tmp_path}/staged")
    told = [writers.scan_canonical(spark, f"{tmp_path}/{n}") for n in ("lines", "points", "staged")]
    assert told[0].count() > 0
    assert same_rows(told[0], told[1]) and same_rows(told[0], told[2])


def test_levels_are_made_on_the_way_to_their_files(spark, tmp_path, monkeypatch):
    """What is stored before is a row for each line, not one for each level, and the levels are those of ``render_levels``."""
    deleted = []
    monkeypatch.setattr(writers, "delete", lambda spark, path: deleted.append(path))
    for chunk in (tr.CHUNK_POINTS, 8):  # no track of several parts, then many
        root = f"{tmp_path}/{chunk}"
        writers.write_canonical(canonical_rows(spark, chunk), root, chunk_points=chunk)
        writers.write_render_pyramid(spark, root, chunk, group_bytes=4000)
        shards = writers.scan_canonical(spark, root)
        parts = shards.groupBy("activity_id").agg(F.max("part").alias("last"))
        single = shards.join(parts.where("last = 0"), "activity_id")
        assert (parts.where("last > 0").count() > 0) == (chunk == 8)
        assert spark.read.parquet(f"{deleted[-1]}/lines").count() == single.count() > 0
        levels = spark.read.parquet(f"{root}/render")
        assert same_rows(levels, writers.render_levels(shards, chunk))

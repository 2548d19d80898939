import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.operators import tracks as tr
from pathfold.operators.ranks import dense_sequence, global_rank
from pathfold.operators.records import merge_records_by_timestamp
from pathfold.sources.event_tracks import event_points

POINT = "activity_id string, seq long, ts timestamp, lon double, lat double, ele double, hr double, cadence double, power double"
T0 = datetime(2025, 1, 1)


def track(spark, rows, name="a"):
    data = [
        (name, i, None if t is None else T0 + timedelta(seconds=t), float(x), float(y), z, None, None, None)
        for i, (x, y, t, z) in enumerate(rows)
    ]
    return spark.createDataFrame(data, POINT)


SPIKES = [
    (-105, 40, 0, 1000.0),
    (0, 0, 10, 1005.0),
    (-105.001, 40.001, 20, 1010.0),
    (-105.002, 40.002, 30, 3000.0),
    (-105.003, 40.003, 40, 1020.0),
]


@pytest.mark.parametrize("chunk", [2, 3, 65536])
def test_clean_track_golden(spark, chunk):
    rows = tr.clean_track(track(spark, SPIKES), chunk).orderBy("seq").collect()
    assert [r.clean for r in rows] == [True, False, True, False, True]
    assert rows[1].dropped_jump and rows[3].dropped_elevation


def test_unknown_time_switches_thresholds(spark):
    # 5 km in no known time is plausible, 25 km is not; the ends always stay.
    far = [(0.0, 0.0, None, None), (0.05, 0.0, None, None), (0.0, 0.0, None, None)]
    farther = [(0.0, 0.0, 5, None), (0.25, 0.0, 5, None), (0.0, 0.0, 4, None)]
    assert all(r.clean for r in tr.clean_track(track(spark, far)).collect())
    assert sum(r.clean for r in tr.clean_track(track(spark, farther)).collect()) == 2
    two = tr.clean_track(track(spark, [(0, 0, 0, 1.0), (90, 0, 1, 9000.0)])).collect()
    assert all(r.clean for r in two)
    one = tr.track_summary(tr.clean_track(track(spark, [(0, 0, 0, 1.0)]))).first()
    assert one.point_count == 1 and one.track_gain_m is None


def test_gain_skips_missing_elevation(spark):
    rows = [(0, 0, 0, 10.0), (0, 0.0001, 10, None), (0, 0.0002, 20, 15.0), (0, 0.0003, 30, 12.0)]
    for chunk in (2, 100):
        s = tr.track_summary(tr.clean_track(track(spark, rows), chunk)).first()
        assert (s.track_gain_m, s.track_loss_m) == (5.0, 3.0)


def test_results_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [
        (float(x), float(y), 10 * i if i % 7 else None, None if i % 5 == 0 else float(z))
        for i, (x, y, z) in enumerate(
            zip(np.cumsum(rng.normal(0, 0.02, 60)), np.cumsum(rng.normal(0, 0.02, 60)), rng.normal(500, 300, 60))
        )
    ]
    points = track(spark, rows)

    def everything(chunk):
        flagged = tr.clean_track(points, chunk)
        clean = tr.clean_points(flagged)
        profile = tr.elevation_profile(points, chunk).select("seq", F.round("distance_m", 6).alias("v"))
        clean_profile = tr.elevation_profile(clean, chunk).select("seq", F.round("distance_m", 6).alias("v"))
        segments = tr.segment_table(tr.split_segments(points, 3000.0, chunk), 1).select(
            F.col("first_seq").alias("seq"), F.col("points").cast("double").alias("v")
        )
        edges = tr.edges(points, chunk).select("seq", F.round("x1", 6).alias("v"))
        summary = tr.track_summary(flagged)
        flat = [round(v, 6) if isinstance(v, float) else v for v in summary.first()]
        both = profile.unionByName(clean_profile).unionByName(segments).unionByName(edges)
        return flat, sorted((r.seq, r.v) for r in both.collect())

    whole = everything(65536)
    assert everything(4) == whole
    assert len(whole[1]) > 150


def test_segments_list_and_batch_forms(spark):
    rows = [(0, 0, 0, None), (1, 0, 1, None), (1.001, 0, 2, None), (3, 0, 3, None)]
    segmented = tr.split_segments(track(spark, rows))
    assert [r.points for r in tr.segment_table(segmented, 2).collect()] == [2]
    assert sorted(r.points for r in tr.segment_table(segmented, 1).collect()) == [1, 1, 2]


def test_hot_groups_number_like_cold_ones(spark):
    rows = [("hot" if i % 3 else f"k{i}", i * 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, n long")
    plain = {tuple(r) for r in dense_sequence(frame, ["k"], "n").collect()}
    split = {tuple(r) for r in dense_sequence(frame, ["k"], "n", hot_rows=16).select("k", "n", "seq").collect()}
    assert plain == split
    ranked = global_rank(frame, ["k", "n"]).collect()
    want = {row: i for i, row in enumerate(sorted(rows))}
    assert {(r.k, r.n): r["rank"] for r in ranked} == want


def test_event_points_split_hot_activities(spark):
    d = "/root/testdata/sf0.001"
    a = event_points(spark, d)
    b = event_points(spark, d, hot_rows=8)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_records_merge(spark):
    schema = "file string, n long, ts timestamp, position_lat long, position_long long, altitude double, enhanced_altitude double, heart_rate long, cadence long, power long"
    rows = [
        ("f", 0, T0, 1, 2, None, None, None, None, None),
        ("f", 1, T0, None, None, None, 1234.5, None, None, None),
        ("f", 2, None, 5, 5, None, None, None, None, None),
        ("f", 3, None, 6, 6, None, None, None, None, None),
    ]
    merged = merge_records_by_timestamp(spark.createDataFrame(rows, schema)).orderBy("n").collect()
    assert len(merged) == 3
    assert (merged[0].position_lat, merged[0].enhanced_altitude, merged[0].altitude) == (1, 1234.5, None)


def test_haversine(spark):
    from pathfold.functions.geo import haversine_m

    got = spark.range(1).select(haversine_m(0, 0, 180, 0).alias("half"), haversine_m(0, 0, 0, 1).alias("one")).first()
    assert got.half == pytest.approx(math.pi * 6371000)
    assert got.one == pytest.approx(math.pi * 6371000 / 180)


def test_top_per_key_salts_large_k(spark):
    from pathfold.operators.ranks import top_per_key

    frame = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    top = top_per_key(frame, ["k"], [F.desc("v")], 1500).collect()
    assert len(top) == 3000 and min(r.v for r in top) == 2000
    assert {r.v: r["rank"] for r in top if r.k == 1}[4999] == 1

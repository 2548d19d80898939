import math

import pytest
from pyspark.sql import functions as F

from pathfold.functions import color, geo, predicates, scalar, text
from pathfold.operators import dimensions as dim
from pathfold.operators import heat
from pathfold.operators import selection as sel
from pathfold.plans.render import clamp_lod, plan_lod


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_levels_and_budgets(spark):
    zooms = spark.createDataFrame([(float(z),) for z in range(4, 20, 2)], "z double")
    lods = [r[0] for r in zooms.select(geo.requested_lod("z")).collect()]
    assert lods == [0, 1, 2, 3, 4, 5, 6, 7]
    row = one(
        spark,
        a=geo.lod_for_metres_per_pixel(7.0),
        b=geo.lod_for_metres_per_pixel(1.5),
        c=geo.scheduled_vertex_budget(6),
        d=geo.scheduled_vertex_budget(10),
        e=geo.scheduled_vertex_budget(14),
        f=geo.scheduled_vertex_budget(6, "medium", True),
        g=geo.scheduled_vertex_budget(10, "medium", True),
        h=geo.scheduled_vertex_budget(14, "medium", True),
    )
    assert tuple(row) == (5, 6, 200_000, 500_000, 750_000, 150_000, 300_000, 500_000)


def test_plan():
    counts = dict(enumerate([1000, 20_000, 95_000, 200_000, 700_000, 1_200_000, 2_000_000, 3_000_000]))
    assert plan_lod(counts, 2, 1_250_000, True).lod == 5
    assert plan_lod(counts, 2, 1_250_000, False).lod == 2
    assert plan_lod(counts, 7, 1_250_000, False).lod == 5
    assert plan_lod(counts, 7, 4_000_000, True).lod == 7
    assert plan_lod(counts, 7, 10, False).lod == 0
    assert clamp_lod([2, 4], 1) == 2 and clamp_lod([2, 4], 3) == 2
    with pytest.raises(ValueError):
        plan_lod({}, 2, 10)


def test_padding_and_bounds(spark):
    plain = one(spark, **dict(zip("wsen", geo.padded_bounds(-10, -5, 10, 5), strict=True)))
    assert tuple(plain) == (-11, -5.5, 11, 5.5)
    wrapped = one(spark, **dict(zip("wsen", geo.padded_bounds(170, -5, -170, 5), strict=True)))
    assert tuple(wrapped) == (170, -5, -170, 5)
    clamped = one(spark, **dict(zip("wsen", geo.padded_bounds(-180, -85, 180, 85), strict=True)))
    assert tuple(clamped) == (-180, -85, 180, 85)
    assert predicates.bounds_contain((0, 0, 4, 4), (1, 1, 2, 2))
    assert not predicates.bounds_contain((4, 0, 0, 4), (1, 1, 2, 2))
    with pytest.raises(ValueError):
        predicates.viewport_intersects((0, 0, math.nan, 1))


def test_spatial_key_matches_bit_loop(spark):
    places = [(-105.0, 40.0), (0.0, 0.0), (179.9, -89.9), (-180.0, 90.0)]
    frame = spark.createDataFrame(places, "x double, y double")
    got = [r[0] for r in frame.select(geo.spatial_key("x", "y")).collect()]
    for key, (x, y) in zip(got, places, strict=True):
        qx, qy = int((x + 180) / 360 * 65535), int((y + 90) / 180 * 65535)
        assert key == sum(((qx >> b & 1) << 2 * b) | ((qy >> b & 1) << 2 * b + 1) for b in range(16))


def test_nulls_stay_null(spark):
    none = F.lit(None).cast("double")
    row = one(
        spark,
        a=geo.clamp(none, 0, 1),
        b=geo.haversine_m(none, 1, 2, 3),
        c=geo.mercator_y(none),
        d=scalar.parse_number(F.lit("Infinity")),
        e=scalar.parse_number(F.lit("1.0d")),
        f=scalar.clamp_negative(none),
        g=geo.finite(F.lit(float("nan"))),
    )
    assert all(v is None for v in row)


def test_text(spark):
    raw = "could not open /home/mia/tracks/today.gpx: secret: q9-z at http://tiles.test/7/3?x=1, access_key=PPQ77"
    out = one(spark, v=text.redact(F.lit(raw)))[0]
    assert not any(s in out for s in ("mia", "q9-z", "tiles.test", "PPQ77")) and out.startswith("could not open ")
    assert all(s in out for s in ("[redacted]", "[url]", "[local-path]"))
    message = "report of a run\nSQL:\nSELECT speed FROM activities\nDuckDB error:\n\nBinder Error: no column speed\nat line 1"
    row = one(
        spark,
        line=text.first_error_line(F.lit(message)),
        a=text.classify_error(F.lit("execute"), F.lit("Binder Error: column nope")),
        b=text.classify_error(F.lit("execute"), F.lit("Out of Memory Error")),
        c=text.classify_error(F.lit("renderViewport"), F.lit("Binder Error")),
        long=F.length(text.redact(F.lit("x" * 1000), 500)),
    )
    assert tuple(row) == ("Binder Error: no column speed", "query", "unexpected", "unexpected", 500)


def test_family_and_paths(spark):
    names = {"Morning Run": "run", "Virtual Ride": "ride", "Snowboard": "ski", "Hike": "foot", "Rowing": "water", "Yoga": "other"}
    frame = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r.s: r.f for r in frame.select("s", scalar.activity_family("s").alias("f")).collect()} == names
    row = one(
        spark,
        a=scalar.source_type(F.lit("x/1.FIT.gz")),
        b=scalar.source_type(F.lit("x/1.gpx")),
        c=scalar.is_supported(F.lit("x/1.TCX.gz")),
        d=scalar.is_supported(F.lit("x/1.txt")),
        e=scalar.normalize_artifact_path(F.lit("builds/b/activities/x"), "activities"),
        f=scalar.normalize_artifact_path(F.lit("/activities/x"), "activities"),
    )
    assert tuple(row) == ("fit", "gpx", True, False, "activities/x", None)
    record = scalar.reject_record(F.lit("a/b.gpx"), F.lit("1"), "parse", "E", F.lit("m" * 400))
    back = spark.range(1).select(scalar.rejection_from_json(scalar.rejection_to_json(record)).alias("r")).first().r
    assert back.source_path == "b.gpx" and len(back.message) == 300


def test_colors(spark):
    row = one(
        spark,
        low=color.heat_color(0.0, 10.0),
        high=color.heat_color(10.0, 10.0),
        flat=color.heat_color(0.0, 0.0, "ice"),
        custom=color.heat_color(10.0, 10.0, "custom:#000000,#ffffff"),
        mid=color.dimension_color(F.lit(5.0), F.lit(0), "numeric", 0.0, 10.0, 3, "custom:#000000,#ffffff"),
        none=color.dimension_color(F.lit(None).cast("double"), F.lit(None).cast("long"), "numeric", 0.0, 10.0, 3),
        hex=color.hex_to_rgba(F.lit("#0a10FF")),
        bad=color.hex_to_rgba(F.lit("#0a10F")),
    )
    assert row.low == [48, 64, 171, 210] and row.high == [226, 48, 92, 255]
    assert row.flat == [8, 29, 88, 210] and row.custom == [255, 255, 255, 255]
    assert row.mid == [128, 128, 128, 255] and row.none is None
    assert row.hex == [10, 16, 255, 255] and row.bad is None
    assert color.is_palette("fire") and not color.is_palette("custom:#000000")
    assert color.custom_palette(["#ABCDEF", "x"]).startswith("custom:#440154")


def test_frames(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "activity_id string, month string")
    values = dim.dimension_values(rows)
    stepped = dim.with_steps(values, dim.dimension_steps(values))

    def shown(mode, window=1):
        return {r.activity_id for r in stepped.where(dim.frame_visible("step", 1, mode, window)).collect()}

    assert shown("cumulative") == {"1", "2"} and shown("windowed") == {"2"}
    assert dim.clamp_step(9, 3) == 2 and dim.clamp_step(-1, 3) == 0
    with pytest.raises(ValueError):
        dim.dimension_values(rows.select("activity_id"))


def test_heat_golden(spark):
    def scores(a, b):
        rows = [("a", 0.0, 0.0)] * a + [("b", 0.0, 0.0)] * b
        frame = spark.createDataFrame(rows, "activity_id string, lon double, lat double")
        out = heat.heat(frame, 0.0, 0.0, 12.0, 400.0, 400.0, 20.0).collect()
        return {r.activity_id: r.score for r in out}

    assert scores(2, 1) == {"a": 1.0, "b": 2.0}
    assert scores(20, 1) == {"a": 1.0, "b": 20.0}
    frame = spark.createDataFrame([("a", 179.999, 0.0), ("b", -179.999, 0.0), ("c", 0.0, 0.0)], "activity_id string, lon double, lat double")
    seen = heat.visible_cells(frame, 180.0, 0.0, 12.0, 400.0, 400.0, 20.0)
    assert {r.activity_id for r in seen.collect()} == {"a", "b"}


def test_selection_rules(spark):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "activity_id string, n int").createOrReplaceTempView("activities")
    assert sel.is_universal(sel.normalize_sql(" SELECT  activity_id\nFROM activities ;; "))
    rows = sel.dedupe_selection(sel.select(spark, "SELECT activity_id, n FROM activities -- all\n;"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError):
        sel.select(spark, "SELECT n FROM activities")
    for command in ("DROP VIEW activities", "CREATE TABLE x AS SELECT 1", "SET a=b"):
        with pytest.raises(Exception):
            sel.select(spark, command)
    assert sel.dimension_columns(spark.sql("SELECT 'x' activity_id, 1 a, array(1) b, current_date() c, 's' d")) == {
        "a": "numeric",
        "c": "temporal",
        "d": "categorical",
    }

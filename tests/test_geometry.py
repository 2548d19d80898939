import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.functions.geo import LOD_TOLERANCES_M
from pathfold.operators import batches, layout, simplify, spatial
from pathfold.plans import render as rn

LINE = "activity_id string, part long, geometry array<array<double>>"
EDGE = "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double"


def lines(spark, *shapes):
    return spark.createDataFrame(
        [(f"l{i}", 0, [[float(x), float(y)] for x, y in s]) for i, s in enumerate(shapes)], LINE
    )


def recursive(x, y, a, b, cap, out):
    """Plain recursion, one vertex at a time."""
    best, at = -1.0, None
    dx, dy = x[b] - x[a], y[b] - y[a]
    for k in range(a + 1, b):
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else min(1.0, max(0.0, ((x[k] - x[a]) * dx + (y[k] - y[a]) * dy) / l2))
        d = np.hypot(x[k] - (x[a] + t * dx), y[k] - (y[a] + t * dy))
        if d > best:
            best, at = d, k
    if at is not None and min(cap, best) > 0:
        out[at] = min(cap, best)
        recursive(x, y, a, at, out[at], out)
        recursive(x, y, at, b, out[at], out)


def test_batch_significance_matches_recursion():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 3, 40, 200, 5]
    xs = [np.cumsum(rng.normal(size=n)) for n in sizes]
    ys = [np.cumsum(rng.normal(size=n)) for n in sizes]
    xs[4][:], ys[4][:] = 1.0, 2.0  # all vertices equal
    ends = np.concatenate([[0], np.cumsum(sizes)])
    got = simplify.batch_significance(np.concatenate(xs), np.concatenate(ys), ends)
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        want = np.zeros(len(x))
        if len(x):
            want[0] = want[-1] = np.inf
            recursive(x, y, 0, len(x) - 1, np.inf, want)
        assert np.allclose(got[ends[i] : ends[i + 1]], want)


def test_simplify_goldens(spark):
    crossing = [(-105 + (i % 17) * 0.001, 40 + (i % 19) * 0.001) for i in range(500)]
    zigzag = [(-105 + i * 0.01, 40 + (i % 2) * 0.00001) for i in range(100)]
    short = [(-105.3, 40), (-105.2, 40.1), (-105.1, 40)]
    frame = lines(spark, crossing, zigzag, short)
    to = simplify.simplify_to_target(frame, "geometry", 40, "few").withColumn(
        "m32", simplify.simplify_m("geometry", 32.0)
    ).withColumn("full", simplify.simplify_m("geometry", None))
    rows = {r.activity_id: r for r in to.collect()}
    assert 2 <= len(rows["l0"].few) <= 40
    assert len(rows["l1"].m32) == 2
    assert rows["l2"].full == rows["l2"].geometry == rows["l2"].few
    for r in rows.values():
        for line in (r.few, r.m32):
            assert line[0] == r.geometry[0] and line[-1] == r.geometry[-1]


def test_dropped_vertices_stay_within_tolerance(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(0, 40, 400))
    y = np.cumsum(rng.normal(0, 40, 400))
    sig = simplify.batch_significance(x, y, np.array([0, 400]))
    previous = 0
    for tolerance in [t for t in LOD_TOLERANCES_M if t]:
        kept = np.flatnonzero(sig > tolerance)
        assert kept[0] == 0 and kept[-1] == 399 and len(kept) >= previous
        previous = len(kept)
        for a, b in zip(kept[:-1], kept[1:], strict=True):
            for k in range(a + 1, b):
                dx, dy = x[b] - x[a], y[b] - y[a]
                t = np.clip(((x[k] - x[a]) * dx + (y[k] - y[a]) * dy) / (dx * dx + dy * dy), 0, 1)
                assert np.hypot(x[k] - x[a] - t * dx, y[k] - y[a] - t * dy) <= tolerance + 1e-9


def test_long_significance_matches_batch(spark):
    rng = np.random.default_rng(9)
    x, y = np.cumsum(rng.normal(size=60)), np.cumsum(rng.normal(size=60))
    want = simplify.batch_significance(x, y, np.array([0, 60]))
    rows = [("a", i, float(x[i]), float(y[i])) for i in range(60)]
    frame = spark.createDataFrame(rows, "activity_id string, seq long, x double, y double")
    values = np.unique(want)
    floor = float((values[len(values) // 2] + values[len(values) // 2 + 1]) / 2)
    got = {r.seq: r.significance for r in simplify.long_significance(frame, floor).collect()}
    assert set(got) == set(np.flatnonzero(want > floor))
    assert all(np.isclose(got[k], want[k]) for k in got)


def crosses(p, q, a, b):
    def side(o, m, n):
        return np.sign((m[0] - o[0]) * (n[1] - o[1]) - (m[1] - o[1]) * (n[0] - o[0]))

    return side(p, q, a) != side(p, q, b) and side(a, b, p) != side(a, b, q)


def contains(ring, x, y):
    odd = False
    for (px, py), (qx, qy) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            odd = not odd
    return odd


RING = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]  # not convex


def test_polygon_predicates_match_sampling(spark):
    rng = np.random.default_rng(11)
    shapes = []
    for _ in range(120):
        start = rng.uniform(-1, 5, 2)
        shapes.append(np.vstack([start, start + np.cumsum(rng.normal(0, 0.6, (3, 2)), axis=0)]))
    edges = [
        (f"l{i}", k, *map(float, s[k]), *map(float, s[k + 1])) for i, s in enumerate(shapes) for k in range(3)
    ]
    boxes = [(f"l{i}", *map(float, s.min(0)), *map(float, s.max(0))) for i, s in enumerate(shapes)]
    edge_frame = spark.createDataFrame(edges, EDGE)
    box_frame = spark.createDataFrame(boxes, "activity_id string, xmin double, ymin double, xmax double, ymax double")
    touch = {r[0] for r in spatial.polygon_filter(box_frame, edge_frame, RING).collect()}
    inside = {r[0] for r in spatial.polygon_filter(box_frame, edge_frame, RING, "within").collect()}
    sides = list(zip(RING, [*RING[1:], RING[0]], strict=True))
    for i, s in enumerate(shapes):
        cut = any(crosses(p, q, s[k], s[k + 1]) for k in range(3) for p, q in sides)
        begun = contains(RING, *s[0])
        assert (f"l{i}" in touch) == (cut or begun)
        assert (f"l{i}" in inside) == (begun and not cut)
    assert touch and inside and touch != inside


def test_polygon_boundary_cases(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    shapes = {
        "touch": [(-1, 2), (0, 2)],
        "side": [(0, 1), (0, 3)],
        "chord": [(0, 1), (4, 3)],
        "apart": [(5, 5), (6, 6)],
        "through": [(-1, -1), (5, 5)],
    }
    edges = [(n, 0, *map(float, a), *map(float, b)) for n, (a, b) in shapes.items()]
    boxes = [
        (n, float(min(a[0], b[0])), float(min(a[1], b[1])), float(max(a[0], b[0])), float(max(a[1], b[1])))
        for n, (a, b) in shapes.items()
    ]
    e = spark.createDataFrame(edges, EDGE)
    b = spark.createDataFrame(boxes, "activity_id string, xmin double, ymin double, xmax double, ymax double")
    assert {r[0] for r in spatial.polygon_filter(b, e, square).collect()} == {"touch", "side", "chord", "through"}
    assert {r[0] for r in spatial.polygon_filter(b, e, square, "within").collect()} == {"chord"}
    assert spatial.polygon_bounds([(-105.3, 39.9), (-105.1, 39.9), (-105.2, 40.1)]) == (-105.3, 39.9, -105.1, 40.1)
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1, 1), (float("nan"), 2)]):
        with pytest.raises(ValueError):
            spatial.check_polygon(bad)


def test_nearest_route_matches_scan(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.uniform(-0.05, 0.05, (300, 2))
    step = rng.normal(0, 0.002, (300, 2))
    edges = [(f"r{i % 40}", i, *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(base, step, strict=True))]
    probes = [(f"p{i}", *map(float, rng.uniform(-0.05, 0.05, 2))) for i in range(60)]
    e = spark.createDataFrame(edges, EDGE)
    p = spark.createDataFrame(probes, "probe_id string, lon double, lat double")
    tolerance = 4e-6
    unit = {(r.activity_id, r.seq): (r.x0, r.y0, r.x1, r.y1) for r in spatial.on_unit_square(e).collect()}
    want = {}
    for name, lon, lat in probes:
        s = np.sin(np.radians(lat))
        x, y = (lon + 180) / 360, 0.5 - np.log((1 + s) / (1 - s)) / (4 * np.pi)
        for key, (x0, y0, x1, y1) in unit.items():
            dx, dy = x1 - x0, y1 - y0
            t = np.clip(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0, 1)
            d = np.hypot(x - x0 - t * dx, y - y0 - t * dy)
            if d < tolerance and d < want.get(name, (1.0,))[0]:
                want[name] = (d, *key)

    def found():
        rows = spatial.nearest_route(p, e, tolerance).collect()
        return {r.probe_id: (r.activity_id, r.seq) for r in rows}

    expected = {n: v[1:] for n, v in want.items()}
    assert 5 < len(expected) < 60 and found() == expected
    assert found() == expected


def test_tiles_match_scan(spark):
    rng = np.random.default_rng(17)
    ends = rng.uniform(-80, 80, (50, 4))
    e = spark.createDataFrame([("r", i, *map(float, v)) for i, v in enumerate(ends)], EDGE)
    margin, scale = 0.01, 8
    got = {(r.tile_x, r.tile_y, r.seq) for r in spatial.tile_segments(e, 3, margin).collect()}
    want = set()
    for r in spatial.on_unit_square(e).collect():
        for x in range(scale):
            for y in range(scale):
                if (
                    min(r.x0, r.x1) <= (x + 1) / scale + margin
                    and max(r.x0, r.x1) >= x / scale - margin
                    and min(r.y0, r.y1) <= (y + 1) / scale + margin
                    and max(r.y0, r.y1) >= y / scale - margin
                ):
                    want.add((x, y, r.seq))
    assert got == want
    part = spatial.tile_segments(e, 3, margin, (2, 2, 4, 4)).collect()
    assert {(r.tile_x, r.tile_y, r.seq) for r in part} == {w for w in want if 2 <= w[0] <= 4 and 2 <= w[1] <= 4}


def test_greedy_groups():
    assert layout.greedy_groups(np.array([3, 3, 3, 9, 1, 20, 1]), 7).tolist() == [0, 0, 1, 2, 3, 4, 5]
    assert layout.greedy_groups(np.array([5, 2, 7, 1]), 7).tolist() == [0, 0, 1, 2]
    assert layout.greedy_groups(np.array([], dtype=int), 7).tolist() == []


def test_str_layout_invariants(spark):
    rng = np.random.default_rng(19)
    rows = [
        (f"a{i}", 0, lod, int(rng.integers(50, 900)), float(x), float(y), float(x) + 0.1, float(y) + 0.1)
        for i, (x, y) in enumerate(rng.uniform(-50, 50, (200, 2)))
        for lod in (0, 1)
    ]
    frame = spark.createDataFrame(
        rows, "activity_id string, part long, lod int, bytes long, xmin double, ymin double, xmax double, ymax double"
    )
    placed = layout.str_layout(frame, 4000).toPandas()
    assert len(placed) == 400 and not placed.duplicated(["activity_id", "lod"]).any()
    groups = placed.groupby(["lod", "stripe", "group_no"])["bytes"].agg(["sum", "size"])
    assert ((groups["sum"] <= 4000) | (groups["size"] == 1)).all()
    for _, stripe in placed.groupby(["lod", "stripe"]):
        ordered = stripe.sort_values("position")
        assert ordered["cy"].is_monotonic_increasing and ordered["group_no"].is_monotonic_increasing
    spans = placed.groupby(["lod", "stripe"])["cx"].agg(["min", "max"]).reset_index()
    for _, s in spans.groupby("lod"):
        s = s.sort_values("stripe")
        assert (s["max"].to_numpy()[:-1] <= s["min"].to_numpy()[1:]).all()


def test_line_segments_and_batches(spark):
    frame = lines(spark, [(0, 0), (1, 0), (1.001, 0)], [(5, 5)], [(0, 0), (0.001, 0)])
    pieces = {(r.activity_id, r.segment_no): len(r.positions) for r in rn.line_segments(frame).collect()}
    assert pieces == {("l0", 0): 1, ("l0", 1): 2, ("l1", 0): 1, ("l2", 0): 2}
    rows = batches.route_batches(frame.coalesce(1)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.start_indices == [0, 1, 3, 4, 6] and row.owners == [0, 0, 1, 2]
    assert row.positions[:4] == [0.0, 0.0, 1.0, 0.0]
    assert [r.seq for r in rn.line_edges(frame).where("activity_id = 'l0'").orderBy("seq").collect()] == [0, 1]


def test_as_of_forward(spark):
    profile = spark.createDataFrame(
        [("a", i, 10.0 * i, 100.0 + i, 0.0, 0.0) for i in range(6)],
        "activity_id string, seq long, distance_m double, ele double, lon double, lat double",
    )
    targets = spark.createDataFrame([("a", 0.0), ("a", 15.0), ("a", 50.0), ("a", 51.0)], "activity_id string, target_m double")
    got = {r.target_m: r.seq for r in spatial.as_of_forward(targets, profile).collect()}
    assert got == {0.0: 0, 15.0: 2, 50.0: 5}
    shares = {r.ratio: r.seq for r in spatial.profile_at(profile, [0.0, 0.31, 1.0], 2).collect()}
    assert shares == {0.0: 0, 0.31: 2, 1.0: 5}


def test_legs_over_the_antimeridian(spark):
    legs = spark.createDataFrame([("a", 0, 179.9, 10.0, -179.9, 10.2), ("b", 0, 0.0, 10.0, 0.1, 10.0)], "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double")
    tiles = spatial.tile_segments(legs, 8).where("activity_id = 'a'").collect()
    assert {r.tile_x for r in tiles} == {0, 255}
    assert spatial.tile_segments(legs, 0).count() == 2
    probes = spark.createDataFrame([(1, -179.95, 10.15), (2, 179.95, 10.05), (3, 90.0, 10.1)], "probe_id long, lon double, lat double")
    found = {r.probe_id: r.activity_id for r in spatial.nearest_route(probes, legs, 0.001).collect()}
    assert found == {1: "a", 2: "a"}


def test_a_ring_of_many_vertices(spark):
    import math

    ring = [(math.cos(i / 250 * math.pi), math.sin(i / 250 * math.pi)) for i in range(500)]
    rows = [("in", 0, 0.1, 0.0, 0.2, 0.3), ("out", 0, 1.2, 0.0, 1.3, 0.1), ("through", 0, -2.0, 0.1, 2.0, 0.1)]
    edges = spark.createDataFrame(rows, "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(i, min(a, c), min(b, d), max(a, c), max(b, d)) for i, _, a, b, c, d in rows], "activity_id string, xmin double, ymin double, xmax double, ymax double")
    assert {r[0] for r in spatial.polygon_filter(boxes, edges, ring).collect()} == {"in", "through"}
    assert {r[0] for r in spatial.polygon_filter(boxes, edges, ring, "within").collect()} == {"in"}
    polygons = spark.createDataFrame([("disc", ring), ("far", [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)]), ("globe", [(-170.0, -80.0), (170.0, -80.0), (0.0, 80.0)])], "polygon_id string, ring array<struct<x: double, y: double>>")
    assert {tuple(r) for r in spatial.polygon_join(edges, polygons).collect()} == {("disc", "in"), ("disc", "through"), ("globe", "in"), ("globe", "out"), ("globe", "through")}


def test_polygon_join_of_all_sizes(spark):
    """Against every pair: tiny, wide and many-sided polygons, short and long edges."""
    rng = random.Random(6)
    rings = []
    for k in range(40):
        x, y, r = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.002, 0.05, 0.4])
        n = rng.choice([3, 4, 9, 60])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        rings.append((f"p{k}", [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]))
    rings.append(("wide", [(-80.0, -60.0), (90.0, -50.0), (5.0, 70.0)]))
    turns = [2 * math.pi * i / 10_000 for i in range(10_000)]
    rings.append(("star", [((0.5 + 0.4 * (i % 2)) * math.cos(t), (0.5 + 0.4 * (i % 2)) * math.sin(t)) for i, t in enumerate(turns)]))
    rings += [("bow", [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]), ("flat", [(0.1, 0.1), (0.9, 0.1), (0.4, 0.1)])]
    polygons = spark.createDataFrame(rings, "polygon_id string, ring array<struct<x:double,y:double>>")
    legs = []
    for k in range(250):
        x, y, size = rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2), rng.choice([0.0, 0.0005, 0.02, 0.6, 40.0])
        legs.append((f"a{k}", 0, x, y, x + rng.uniform(-size, size), y + rng.uniform(-size, size)))
    edges = spark.createDataFrame(legs, "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double")
    got = {tuple(r) for r in spatial.polygon_join(edges, polygons).collect()}
    listed = polygons.withColumn("ring", spatial.sides_of(F.col("ring"))).crossJoin(edges)  # 44 polygons by 250 edges
    want = {(r.polygon_id, r.activity_id) for r in listed.where(spatial.edge_intersects(F.col("ring"))).select("polygon_id", "activity_id").collect()}
    assert got == want and len({p for p, _ in want}) > 25


def test_cover_cells_hold_few_polygons(spark):
    """A wide polygon among many small ones is listed at its own level only."""
    small = [(f"s{k}", [(k / 500, 0.0), (k / 500 + 0.001, 0.0), (k / 500, 0.001)]) for k in range(400)]
    wide = [("wide", [(-170.0, -80.0), (170.0, -80.0), (0.0, 85.0)])]
    polygons = spark.createDataFrame(small + wide, "polygon_id string, ring array<struct<x:double,y:double>>")
    legs = [(f"a{k}", 0, k / 2000, 0.0005, k / 2000 + 0.0001, 0.0005) for k in range(2000)]
    edges = spark.createDataFrame(legs, "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double")
    areas = polygons.select("polygon_id", F.xxhash64("polygon_id").alias("polygon_key"), spatial.sides_of(F.col("ring")).alias("ring"), spatial.polygon_bounds_of(F.col("ring")).alias("b"))
    cells = spatial.polygon_cover(areas.withColumn("level", F.when(F.col("polygon_id") == "wide", 2).otherwise(16)))
    assert cells.groupBy("level", "x", "y").count().agg(F.max("count")).first()[0] <= 4
    out = spatial.polygon_join(edges, polygons)
    assert out.where("polygon_id = 'wide'").count() == 2000 and out.where("polygon_id <> 'wide'").count() > 400


def test_lines_are_measured_in_bounded_runs(spark, monkeypatch):
    """A batch of lines is measured a run of vertices at a time, for all targets at once."""
    import numpy as np
    import pyarrow as pa

    from pathfold.operators import simplify as sm

    rng, sizes = np.random.default_rng(5), [3, 0, 9, 1, 2, 4, 30, 5]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    xs, ys = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rng.random(ends[-1]))) for _ in "xy")
    whole = sm._significance.func(xs, ys).to_pylist()
    measure, seen = sm.batch_significance, []
    monkeypatch.setattr(sm, "RUN_VERTICES", 10, raising=False)
    monkeypatch.setattr(sm, "batch_significance", lambda x, y, e: seen.append((len(x), len(e) - 1)) or measure(x, y, e))
    assert sm._significance.func(xs, ys).to_pylist() == whole
    assert len(seen) > 3 and all(n <= 10 or lines == 1 for n, lines in seen)
    assert sum(n for n, _ in seen) == ends[-1] and sum(n for _, n in seen) == len(sizes)

    rows = [(n, [[x, y] for x, y in rng.random((size, 2)).tolist()]) for n, size in enumerate(sizes)]
    lines = spark.createDataFrame(rows, "n long, line array<array<double>>")
    both = sm.simplify_to_targets(lines, "line", {"a": 3, "b": 6})
    for name, target in (("a", 3), ("b", 6)):
        one = sm.simplify_to_target(lines, "line", target, name).select("n", name)
        assert sorted(one.collect()) == sorted(both.select("n", name).collect())


def test_nearest_route_in_a_crowded_cell(spark, monkeypatch):
    """Tiles of a crowded cell give the rows that listing each pair gives, ties by route and number included."""
    rng = np.random.default_rng(29)
    ends = np.round(rng.uniform(0, 0.005, (700, 4)), 4)  # on a lattice, so that distances are equal
    ends[:20, 2:] = ends[:20, :2]  # without length
    ends = np.concatenate([ends, ends[:300]])  # copies on other routes
    rows = [(f"r{i % 90}" if i % 50 else None, i, *map(float, v)) for i, v in enumerate(ends)]
    rows += [("none", 0, None, 0.001, 0.002, 0.003), ("far", 1, 1.0, 1.0, 1.001, 1.0)]
    probes = [(f"p{i % 240}", *map(float, v)) for i, v in enumerate(np.round(rng.uniform(0, 0.005, (260, 2)), 4))]
    probes += [(f"same{i}", 0.0021, 0.0033) for i in range(30)] + [("lost", None, 0.001), (None, 0.001, 0.001), ("away", 40.0, 40.0)]
    e = spark.createDataFrame(rows, EDGE)
    p = spark.createDataFrame(probes, "probe_id string, lon double, lat double")

    def found(pairs, tile):
        monkeypatch.setattr(spatial, "CELL_PAIRS", pairs)
        monkeypatch.setattr(spatial, "TILE_ROWS", tile)
        got = spatial.nearest_route(p, e, 2e-6)
        return sorted(map(repr, got.collect()))

    listed = found(1 << 40, 1 << 16)
    monkeypatch.setattr(spatial, "LEAF_PAIRS", 64)
    assert len(listed) > 200 and listed == found(0, 1 << 16) == found(0, 100)


def test_nearest_segments_look_at_few_of_many(monkeypatch):
    rng = np.random.default_rng(31)
    x, y = 0.3 + rng.random((2, 1500)) * 1e-5
    ends = list(0.3 + rng.random((4, 20_000)) * 1e-5)
    looked, hypot = [], np.sqrt
    monkeypatch.setattr(spatial.np, "sqrt", lambda v: looked.append(v.size) or hypot(v))
    at, d = spatial.nearest_segments(x, y, ends, 4e-6)
    monkeypatch.undo()
    assert sum(looked) < 1500 * 20_000 / 4
    x0, y0, x1, y1 = ends
    for i in range(0, 1500, 60):
        t = np.clip(((x[i] - x0) * (x1 - x0) + (y[i] - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0, 1)
        every = np.hypot(x[i] - x0 - t * (x1 - x0), y[i] - y0 - t * (y1 - y0))
        assert at[i] == every.argmin() and abs(d[i] - every.min()) < 1e-15

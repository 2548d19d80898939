"""Values that lie on a border or are equal: the last bit decides, as in the SQL of the queries."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pathfold.functions import color
from pathfold.operators import simplify as sm
from pathfold.operators import spatial as sp
from suite.registry_queries import QUERIES as REGISTRY

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_strictly_within_does_not_touch(spark):
    lines = [("touches", 0.0, 1.0, 2.0, 2.0), ("inside", 1.0, 1.0, 2.0, 2.0), ("leaves", 1.0, 1.0, 5.0, 2.0), ("ends on it", 1.0, 1.0, 4.0, 2.0)]
    edges = spark.createDataFrame([(n, 0, *e) for n, *e in lines], "activity_id string, seq long, x0 double, y0 double, x1 double, y1 double")
    boxes = edges.selectExpr("activity_id", "least(x0, x1) xmin", "least(y0, y1) ymin", "greatest(x0, x1) xmax", "greatest(y0, y1) ymax")

    def ids(predicate):
        return {r.activity_id for r in sp.polygon_filter(boxes, edges, SQUARE, predicate).collect()}

    assert ids("strictly within") == {"inside"}
    assert ids("within") == {"inside", "touches", "ends on it"}


def test_inside_decides_points_on_a_side_as_the_sql_does(spark):
    px, py, qx, qy = -104.97, 39.53, -105.0, 39.59
    near = [(-104.97 - k * 0.00025, 39.53 + k * 0.0005) for k in range(1, 120)]
    want = [x < (qx - px) * (y - py) / (qy - py) + px for x, y in near]
    side = F.array(F.array(*[F.lit(v) for v in (px, py, qx, qy)]))
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(near)], "i long, x double, y double")
    got = [r.h for r in rows.select("i", sp.inside(F.col("x"), F.col("y"), side).alias("h")).orderBy("i").collect()]
    assert any(want) and not all(want) and got == want


def plain(points, a, b, cap, out):
    best = None
    (ax, ay), (bx, by) = points[a], points[b]
    for k in range(a + 1, b):
        x, y = points[k]
        l2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / l2)) if l2 else 0.0
        dx, dy = x - (ax + t * (bx - ax)), y - (ay + t * (by - ay))
        d = math.sqrt(dx * dx + dy * dy)
        if best is None or d > best[0]:
            best = (d, k)
    if best and min(cap, best[0]) > 0:
        out[best[1]] = min(cap, best[0])
        plain(points, a, best[1], out[best[1]], out)
        plain(points, best[1], b, out[best[1]], out)


def test_significance_to_the_last_bit():
    draw = random.Random(3)
    for _ in range(60):
        n = draw.randrange(3, 40)
        points = [(-104.4 + draw.randrange(97) * 0.00005, 39.9 + draw.randrange(89) * 0.00005) for _ in range(n)]
        want = [math.inf] + [0.0] * (n - 2) + [math.inf]
        plain(points, 0, n - 1, math.inf, want)
        x, y = np.array(points).T
        assert sm.batch_significance(x, y, np.array([0, n])).tolist() == want


def test_heat_color_beyond_the_scale(spark):
    rows = spark.createDataFrame([(1.0,), (500.0,), (1000.0,), (None,)], "value double")
    got = [r.c for r in rows.select(color.heat_color("value", 500.0, "ice", 0.1).alias("c")).collect()]
    assert got[0] is not None and got[1] == list(color.PRESETS["ice"][-1])
    assert got[2] is None and got[3] is None  # no colour, not one of null channels


def test_archive_listing_of_any_size(spark, tmp_path):
    rows = spark.range(100_001).selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert REGISTRY["archive_entries"](spark, str(tmp_path)).count() == 100_002

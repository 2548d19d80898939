"""A session over a written store, hand-over of lines as batches, vertex targets of long lines, heat of chosen routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.operators import heat
from pathfold.operators import simplify as sm
from pathfold.operators import tracks as tr
from pathfold.operators.batches import route_batches
from pathfold.plans.dataset_session import DatasetSession, SelectionSpec
from pathfold.schema import LINE_TARGETS

from .base import flagged, points, q, rounded, with_flags, with_points
from .derive_queries import CAMERA, CELLS
from .store_queries import FILES, written
from .track_queries import ORDER_KEY, _walk

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register(
    "route_batches",
    with_flags(
        f""", cut AS (SELECT *, sum(CASE WHEN leg_m > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY activity_id ORDER BY seq) AS s FROM flags),
      seg AS (SELECT activity_id, s, count(*) AS vertices, min_by(lon, seq) AS first_lon, max_by(lat, seq) AS last_lat FROM cut GROUP BY ALL)
      SELECT activity_id, row_number() OVER (PARTITION BY activity_id ORDER BY s) - 1 AS segment_no, vertices, {q('first_lon', 6)} AS first_lon, {q('last_lat', 6)} AS last_lat FROM seg"""
    ),
)
def _(spark, d):
    """Lines handed over as flat coordinates, read back segment by segment."""
    batches = route_batches(tr.track_parts(flagged(spark, d)).select("activity_id", "geometry"))
    start = F.col("start_indices")

    def segment(owner, i):
        return F.struct(
            F.get("activity_ids", owner).alias("activity_id"),
            i.alias("at"),
            (F.get(start, i + 1) - F.get(start, i)).cast("long").alias("vertices"),
            F.get("positions", F.get(start, i) * 2).alias("first_lon"),
            F.get("positions", F.get(start, i + 1) * 2 - 1).alias("last_lat"),
            # Owners are in order, so a route's first segment is where its number first occurs.
            (i - F.array_position("owners", owner) + 1).cast("long").alias("segment_no"),
        )

    segments = batches.select(F.explode(F.transform("owners", segment)).alias("s")).select("s.*")
    return rounded(segments.select("activity_id", "segment_no", "vertices", "first_lon", "last_lat"), 6)


# Long lines: the tracks of fifty neighbouring users one after the other.
LONG = ", long AS (SELECT 'line ' || (u // 50) AS line, row_number() OVER (PARTITION BY u // 50 ORDER BY u, week, seq) AS n, lon, lat, clean FROM flags)"
BOTH = """, lines AS (SELECT line || ' raw' AS activity_id, n AS seq, lon, lat FROM long
  UNION ALL SELECT line || ' clean', n, lon, lat FROM long WHERE clean)"""
TARGETS = ", ".join(f"({t})" for t in LINE_TARGETS)


@register(
    "simplify_targets",
    ORDER_KEY
    + with_flags("").removeprefix("WITH ").rstrip()
    + LONG
    + BOTH
    + ", "
    + _walk("lines", "0.0", "lon", "lat")
    + f""", sig AS (SELECT DISTINCT activity_id, m, sig FROM walk WHERE m IS NOT NULL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY sig DESC) AS rn FROM sig),
  n AS (SELECT activity_id, t.target, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) / 1048576.0 AS step FROM v, (VALUES {TARGETS}) t(target) GROUP BY 1, 2),
  th AS (SELECT n.*, greatest(1.0, ceil(coalesce(rk.sig, 0.0) / nullif(step, 0))) AS k FROM n LEFT JOIN rk ON rk.activity_id = n.activity_id AND rk.rn = n.target - 1),
  cut AS (SELECT *, CASE WHEN n <= target THEN -1.0 WHEN step = 0 THEN 0.0 WHEN k >= 1048576 THEN -1.0 ELSE k * step END AS cut FROM th)
  SELECT cut.activity_id AS line, CAST(target AS INTEGER) AS target, CASE WHEN cut < 0 THEN n ELSE 2 + count(sig.m) END AS vertices
  FROM cut LEFT JOIN sig ON sig.activity_id = cut.activity_id AND sig.sig > cut.cut GROUP BY cut.activity_id, target, n, cut""",
)
def _(spark, d):
    """Vertices that the stored targets leave of long lines, raw and clean."""
    ids = F.split("activity_id", "-")
    clean = ~F.col("dropped_jump") & ~F.col("dropped_elevation")
    at = F.struct(ids[0].cast("long").alias("u"), ids[1].cast("long").alias("week"), "seq", F.array("lon", "lat").alias("p"))
    line = F.concat(F.lit("line "), F.floor(ids[0].cast("long") / 50))
    kinds = F.explode(F.when(clean, F.array(F.lit(" raw"), F.lit(" clean"))).otherwise(F.array(F.lit(" raw"))))
    told = flagged(spark, d).withColumn("at", at).select(line.alias("line"), "at", kinds.alias("kind"))
    lines = told.groupBy(F.concat("line", "kind").alias("line")).agg(F.transform(F.sort_array(F.collect_list("at")), lambda z: z["p"]).alias("geometry"))
    cut = sm.simplify_to_targets(lines, "geometry", {f"to_{target}": target for target in LINE_TARGETS})
    left = [F.struct(F.lit(target).alias("target"), F.size(f"to_{target}").cast("long").alias("vertices")) for target in LINE_TARGETS]
    return cut.select("line", F.explode(F.array(*left)).alias("n")).select("line", "n.*")


LONGEST = "(SELECT max({'n': n, 'id': activity_id}).id FROM (SELECT activity_id, count(*) AS n FROM pts WHERE lat BETWEEN 39.8 AND 40.0 GROUP BY 1))"


def chosen_cells(test: str) -> str:
    return CELLS.replace("FROM pts)", f"FROM pts WHERE activity_id {test} {LONGEST})", 1)


@register("heat_without_route", with_points(f", {chosen_cells('<>')} SELECT activity_id, {q('score', 6)} AS score, visible_vertices FROM score"))
def _(spark, d):
    """Scores when the longest route is left out."""
    p = points(spark, d)
    return rounded(heat.heat(p, **CAMERA, exclude=longest(p)), 6)


@register("heat_route_alone", with_points(f", {chosen_cells('=')} SELECT activity_id, {q('score', 6)} AS score, visible_vertices FROM score"))
def _(spark, d):
    """The longest route alone: it overlaps with nothing."""
    p = points(spark, d)
    return rounded(heat.heat(p, **CAMERA, isolate=longest(p)), 6)


def longest(p) -> str | None:
    """The route with most points at the camera's latitudes."""
    sizes = p.where("lat BETWEEN 39.8 AND 40.0").groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max(F.struct("n", "activity_id")).alias("b")).select("b.activity_id").first()[0]


@register(
    "activity_detail",
    f"""{FILES}, one AS (SELECT max(id) AS id FROM stored)
      SELECT id AS activity_id, CAST(0 AS BIGINT) AS part, 'Track "' || id || '", and more' AS name,
        list_extract(['Run', 'Trail Run', 'Ride', 'Walk', 'Kayaking', 'Workout'], CAST(u % 6 + 1 AS BIGINT)) AS sport_type,
        point_count AS vertices, {q('first_lon', 5)} AS first_lon, {q('last_lat', 5)} AS last_lat
      FROM stored JOIN one USING (id)""",
)
def _(spark, d):
    """Scalars and line of one activity of a store, found by its family and place in the shards."""
    session = DatasetSession(spark, written(spark, d)[1])
    last = session.metadata.agg(F.max("activity_id")).first()[0]
    path = F.col("path")
    rows = session.activity_detail(last).select(
        "activity_id", F.col("part").cast("long").alias("part"), "name", "sport_type", F.size(path).cast("long").alias("vertices"),
        F.get(path, F.lit(0))[0].alias("first_lon"), F.get(path, F.size(path) - 1)[1].alias("last_lat"),
    )
    return rounded(rows, 5)


CHOICES = {
    "all": "SELECT activity_id FROM activities",
    "all, spaced": "select  activity_id\n from ACTIVITIES ;",
    "foot": "SELECT activity_id FROM activities WHERE activity_family = 'foot'",
    "none": "SELECT activity_id FROM activities WHERE false",
}


@register(
    "session_selections",
    f"""{FILES} SELECT 'all' AS choice, true AS universal, count(*) AS n FROM stored
      UNION ALL SELECT 'all, spaced', true, count(*) FROM stored
      UNION ALL SELECT 'foot', false, count(*) FROM stored WHERE activity_family = 'foot'
      UNION ALL SELECT 'none', false, 0""",
)
def _(spark, d):
    """Which selections need no join, and how many activities each leaves."""
    session = DatasetSession(spark, written(spark, d)[1])
    rows = [(name, session.execute(SelectionSpec(sql)) is None, session.count()) for name, sql in CHOICES.items()]
    session.close()
    return spark.createDataFrame(rows, "choice string, universal boolean, n long")

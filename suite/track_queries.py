"""Point-level operators over the derived tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.functions import geo, scalar
from pathfold.operators import activities as act
from pathfold.operators import records as rec
from pathfold.operators import selection as sel
from pathfold.operators import simplify as sm
from pathfold.operators import spatial as sp
from pathfold.operators import tracks as tr
from pathfold.schema import SCALARS

from .base import (
    ACTIVITIES,
    SUMMARY,
    activities,
    flagged,
    hav,
    points,
    q,
    r,
    records,
    rounded,
    stamp,
    table,
    with_activities,
    with_flags,
    with_points,
)

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
    "clean_track_flags",
    with_flags("SELECT activity_id, seq, clean, dropped_jump, dropped_elevation FROM flags"),
)
def _(spark, d):
    return flagged(spark, d).select(
        "activity_id", "seq", "clean", "dropped_jump", "dropped_elevation"
    )


MEASURES = (
    "point_count",
    "clean_point_count",
    "dropped_jump_points",
    "dropped_elevation_points",
    "track_distance_m",
    "clean_distance_m",
    "track_gain_m",
    "track_loss_m",
    "clean_elevation_gain_m",
    "clean_elevation_loss_m",
    "min_elevation",
    "max_elevation",
    "clean_min_elevation",
    "clean_max_elevation",
    "xmin",
    "ymin",
    "xmax",
    "ymax",
    "clean_xmin",
    "clean_ymin",
    "clean_xmax",
    "clean_ymax",
)


@register(
    "track_summary",
    f"WITH {SUMMARY} SELECT activity_id, "
    + ", ".join(m if "count" in m or "points" in m else f"{q(m)} AS {m}" for m in MEASURES)
    + " FROM summary",
)
def _(spark, d):
    return rounded(tr.track_summary(flagged(spark, d)).select("activity_id", *MEASURES))


DOUBLES = [f.name for f in SCALARS.fields if f.dataType.simpleString() == "double"]
PLAIN = [
    "activity_id",
    "source_activity_id",
    "source_filename",
    "source_type",
    "source_checksum",
    "name",
    "sport_type",
    "original_start_time",
    "source_url",
    "point_count",
    "clean_point_count",
    "dropped_jump_points",
    "dropped_elevation_points",
    "spatial_order",
    "distance_source",
    "moving_time_source",
    "elevation_source",
    "activity_family",
]


@register(
    "activity_rows",
    with_activities(
        f"SELECT {', '.join(PLAIN)}, {', '.join(f'{q(x)} AS {x}' for x in DOUBLES)}, "
        "strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, "
        "strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, "
        "year(start_time) AS start_year, month(start_time) AS start_month, "
        "'1.6.0' AS schema_version, '0.6.0' AS compiler_version FROM activities"
    ),
)
def _(spark, d):
    return rounded(
        activities(spark, d).withColumns(
            {"start_time": stamp("start_time"), "end_time": stamp("end_time")}
        )
    )


@register(
    "leg_distance",
    with_flags(
        f"SELECT activity_id, seq, {q('leg_m')} AS leg_m, {q('sum(leg_m) OVER (PARTITION BY activity_id ORDER BY seq)')} AS distance_m FROM flags"
    ),
)
def _(spark, d):
    return tr.cumulative_distance(points(spark, d)).select(
        "activity_id", "seq", r("leg_m").alias("leg_m"), r("distance_m").alias("distance_m")
    )


@register(
    "gain_loss",
    f"WITH {SUMMARY} SELECT activity_id, {q('track_gain_m')} AS gain, {q('track_loss_m')} AS loss, elevations FROM summary",
)
def _(spark, d):
    return tr.track_summary(flagged(spark, d)).select(
        "activity_id", r("track_gain_m").alias("gain"), r("track_loss_m").alias("loss"), "elevations"
    )


PROFILE = "prof AS (SELECT *, sum(leg_m) OVER (PARTITION BY activity_id ORDER BY seq) AS dist FROM flags)"


@register(
    "elevation_profile",
    with_flags(
        f", {PROFILE} SELECT activity_id, seq, {q('dist')} AS distance_m, {q('ele')} AS ele, {q('lon', 6)} AS lon, {q('lat', 6)} AS lat FROM prof WHERE ele IS NOT NULL"
    ),
)
def _(spark, d):
    return tr.elevation_profile(points(spark, d)).select(
        "activity_id",
        "seq",
        r("distance_m").alias("distance_m"),
        r("ele").alias("ele"),
        r("lon", 6).alias("lon"),
        r("lat", 6).alias("lat"),
    )


CLEAN_PROFILE = f"""
  , c AS (SELECT *, lag(lon) OVER w AS a, lag(lat) OVER w AS b, row_number() OVER w - 1 AS k
      FROM flags WHERE clean WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
  d AS (SELECT *, sum(coalesce({hav('a', 'b', 'lon', 'lat')}, 0.0)) OVER (PARTITION BY activity_id ORDER BY seq) AS dist FROM c)
  SELECT activity_id, CAST(k AS BIGINT) AS seq, {q('dist')} AS distance_m, {q('ele')} AS ele FROM d WHERE ele IS NOT NULL"""


@register("elevation_profile_clean", with_flags(CLEAN_PROFILE))
def _(spark, d):
    profile = tr.elevation_profile(tr.clean_points(flagged(spark, d)))
    return profile.select(
        "activity_id", "seq", r("distance_m").alias("distance_m"), r("ele").alias("ele")
    )


RATIOS = (0.0, 0.25, 0.5, 0.9, 1.0)


@register(
    "profile_asof",
    with_flags(
        f""", {PROFILE}, s AS (SELECT * FROM prof WHERE ele IS NOT NULL),
  m AS (SELECT activity_id, CASE WHEN max(dist) = 0 THEN 1.0 ELSE max(dist) END AS len FROM s GROUP BY 1),
  g AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in RATIOS)}]) AS ratio),
  hit AS (SELECT s.activity_id, g.ratio, min(s.seq) AS seq FROM s JOIN m USING (activity_id) JOIN g ON s.dist >= g.ratio * m.len GROUP BY ALL),
  lastone AS (SELECT activity_id, max(seq) AS seq FROM s GROUP BY 1),
  pick AS (SELECT m.activity_id, g.ratio, coalesce(hit.seq, lastone.seq) AS seq FROM m CROSS JOIN g
     LEFT JOIN hit ON hit.activity_id = m.activity_id AND hit.ratio = g.ratio JOIN lastone ON lastone.activity_id = m.activity_id)
  SELECT activity_id, ratio, seq, {q('ele')} AS ele, {q('dist')} AS distance_m FROM pick JOIN s USING (activity_id, seq)"""
    ),
)
def _(spark, d):
    picked = sp.profile_at(tr.elevation_profile(points(spark, d)), RATIOS)
    return picked.select(
        "activity_id", "ratio", "seq", r("ele").alias("ele"), r("distance_m").alias("distance_m")
    )


@register(
    "profile_asof_targets",
    with_flags(
        f""", {PROFILE}, s AS (SELECT * FROM prof WHERE ele IS NOT NULL),
  tg AS (SELECT DISTINCT activity_id, CAST(100 * (u % 9) AS DOUBLE) AS target_m FROM pts),
  h AS (SELECT activity_id, target_m, min(seq) AS seq FROM s JOIN tg USING (activity_id) WHERE dist >= target_m GROUP BY ALL)
  SELECT activity_id, target_m, seq, {q('ele')} AS ele FROM h JOIN s USING (activity_id, seq)"""
    ),
)
def _(spark, d):
    p = points(spark, d)
    user = F.split("activity_id", "-")[0].cast("long")
    targets = p.select("activity_id", ((user % 9) * 100.0).alias("target_m")).distinct()
    hits = sp.as_of_forward(targets, tr.elevation_profile(p))
    return hits.select("activity_id", "target_m", "seq", r("ele").alias("ele"))


SEGMENTS = """, sg AS (SELECT *, CAST(sum(CASE WHEN leg_m > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY activity_id ORDER BY seq) AS BIGINT) AS segment_no FROM flags)
  SELECT activity_id, segment_no, count(*) AS points, min(seq) AS first_seq, max(seq) AS last_seq
  FROM sg GROUP BY 1, 2 HAVING count(*) >= {}"""


@register("split_segments", with_flags(SEGMENTS.format(2)))
def _(spark, d):
    return tr.segment_table(tr.split_segments(points(spark, d)), 2).select(
        "activity_id", "segment_no", "points", "first_seq", "last_seq"
    )


@register("split_segments_batch", with_flags(SEGMENTS.format(1)))
def _(spark, d):
    return tr.segment_table(tr.split_segments(points(spark, d)), 1).select(
        "activity_id", "segment_no", "points", "first_seq", "last_seq"
    )


@register(
    "track_arrays",
    with_flags(
        """SELECT activity_id, CAST(0 AS BIGINT) AS part, count(*) AS n, count(*) FILTER (WHERE clean) AS clean_n,
      string_agg(seq || ':' || clean, ',' ORDER BY seq) AS flags,
      round(min_by(lon, seq), 6) AS first_lon, round(max_by(lat, seq), 6) AS last_lat,
      round(min_by(lon, seq) FILTER (WHERE clean), 6) AS first_clean_lon, round(max_by(lat, seq) FILTER (WHERE clean), 6) AS last_clean_lat
      FROM flags GROUP BY activity_id"""
    ),
)
def _(spark, d):
    g, c = F.col("geometry"), F.col("geometry_clean")
    text = F.transform(
        "track_points", lambda p: F.concat_ws(":", p["sequence"], p["clean"].cast("string"))
    )
    return tr.track_parts(flagged(spark, d)).select(
        "activity_id",
        "part",
        F.size(g).cast("long").alias("n"),
        F.size(c).cast("long").alias("clean_n"),
        F.array_join(text, ",").alias("flags"),
        F.round(g[0][0], 6).alias("first_lon"),
        F.round(F.element_at(g, -1)[1], 6).alias("last_lat"),
        F.round(c[0][0], 6).alias("first_clean_lon"),
        F.round(F.element_at(c, -1)[1], 6).alias("last_clean_lat"),
    )


@register("telemetry_exists", with_flags("SELECT DISTINCT activity_id FROM flags WHERE ele >= 3000"))
def _(spark, d):
    parts = tr.track_parts(flagged(spark, d))
    high = F.exists("track_points", lambda p: p["elevation_m"] >= 3000)
    return parts.where(high).select("activity_id").distinct()


@register(
    "telemetry_unnest",
    with_flags(
        "SELECT activity_id, count(*) AS samples, max(hr) AS max_hr, sum(power) AS total_power FROM flags WHERE clean AND hr >= 150 GROUP BY 1"
    ),
)
def _(spark, d):
    tr.track_parts(flagged(spark, d)).createOrReplaceTempView("activities_full")
    return spark.sql(
        """SELECT activity_id, count(*) AS samples, max(p.heart_rate) AS max_hr, sum(p.power) AS total_power
           FROM activities_full LATERAL VIEW explode(track_points) t AS p
           WHERE p.clean AND p.heart_rate >= 150 GROUP BY activity_id"""
    )


@register(
    "points_roundtrip",
    with_flags(
        f"SELECT activity_id, seq, {q('lon', 6)} AS lon, {q('ele')} AS ele, hr, cadence, power, clean FROM flags"
    ),
)
def _(spark, d):
    back = tr.points_from_parts(tr.track_parts(flagged(spark, d)))
    return back.select(
        "activity_id", "seq", r("lon", 6).alias("lon"), r("ele").alias("ele"), "hr", "cadence", "power", "clean"
    )


@register(
    "reject_split",
    f"""WITH {SUMMARY} SELECT activity_id || '.gpx' AS source_path,
      CASE WHEN (u * 7 + week) % 9 <> 0 THEN activity_id END AS source_activity_id, 'parse' AS stage,
      'ValueError' AS reason_code, 'activity has fewer than two valid route points' AS message
      FROM summary WHERE point_count < 2
      UNION ALL SELECT 'accepted', NULL, 'accepted', CAST(count(*) AS VARCHAR), NULL FROM summary WHERE point_count >= 2""",
)
def _(spark, d):
    p = points(spark, d)
    good, short = act.split_accepted(tr.track_summary(tr.clean_track(p)))
    rejected = act.short_track_rejections(short, records(p))
    none = F.lit(None).cast("string")
    accepted = good.agg(F.count(F.lit(1)).cast("string").alias("reason_code")).select(
        F.lit("accepted").alias("source_path"),
        none.alias("source_activity_id"),
        F.lit("accepted").alias("stage"),
        "reason_code",
        none.alias("message"),
    )
    return rejected.unionByName(accepted)


@register(
    "clean_view",
    with_activities(
        f"""SELECT activity_id, {q('coalesce(clean_distance_m, distance_m)')} AS distance_m,
      {q('coalesce(clean_elevation_gain_m, elevation_gain_m)')} AS elevation_gain_m,
      {q('coalesce(clean_elevation_loss_m, elevation_loss_m)')} AS elevation_loss_m,
      {q('coalesce(clean_min_elevation_m, min_elevation_m)')} AS min_elevation_m,
      {q('coalesce(clean_max_elevation_m, max_elevation_m)')} AS max_elevation_m,
      clean_point_count AS point_count, {q('clean_xmin', 6)} AS xmin, {q('clean_ymax', 6)} AS ymax FROM activities"""
    ),
)
def _(spark, d):
    v = act.clean_view(activities(spark, d))
    names = ("distance_m", "elevation_gain_m", "elevation_loss_m", "min_elevation_m", "max_elevation_m")
    return v.select(
        "activity_id",
        *[r(n).alias(n) for n in names],
        "point_count",
        r("xmin", 6).alias("xmin"),
        r("ymax", 6).alias("ymax"),
    )


# Decoded device records: every event gives a position record and, with the same coarse time
# stamp, a telemetry record; stamps repeat inside a user's file and some are missing.
RECORDS = """dec AS (
  SELECT 'f' || user_id AS file, event_id * 2 + k AS n,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS ts,
    CASE WHEN k = 0 AND event_id % 7 <> 0 THEN (event_id % 1000) * 1000000 END AS position_lat,
    CASE WHEN k = 0 AND event_id % 7 <> 0 THEN -(event_id % 900) * 1000000 END AS position_long,
    CASE WHEN k = 0 AND event_id % 5 = 0 THEN value END AS altitude,
    CASE WHEN k = 1 AND event_id % 3 = 0 THEN value + 1000 END AS enhanced_altitude,
    CASE WHEN k = 1 THEN event_id % 90 + 90 END AS heart_rate,
    CASE WHEN k = 1 AND event_id % 2 = 0 THEN event_id % 60 END AS cadence,
    CASE WHEN k = 1 AND event_id % 4 = 0 THEN event_id % 300 END AS power
  FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x)"""


def decoded(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_for_records")
    return spark.sql(
        f"WITH {RECORDS.replace('FROM events ', 'FROM events_for_records ')} SELECT *, ts AS t FROM dec"
    ).withColumn("ts", F.col("ts").cast("timestamp")).drop("t")


MERGED = f"""WITH {RECORDS},
g AS (SELECT *, CASE WHEN ts IS NULL THEN n END AS alone FROM dec),
m AS (SELECT file, ts, min(n) AS n, {', '.join(f'max_by({f}, n) FILTER (WHERE {f} IS NOT NULL) AS {f}' for f in rec.FIELDS)}
  FROM g GROUP BY file, ts, alone)"""


@register(
    "record_merge",
    MERGED
    + f"""SELECT file, n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, position_lat, position_long, {q('altitude')} AS altitude,
      {q('enhanced_altitude')} AS enhanced_altitude, heart_rate, cadence, power FROM m""",
)
def _(spark, d):
    m = rec.merge_records_by_timestamp(decoded(spark, d))
    return rounded(m.withColumn("ts", stamp("ts"))).select("file", "n", "ts", *rec.FIELDS)


@register(
    "record_points",
    MERGED
    + f""", p AS (SELECT *, position_long * 180.0 / 2147483648.0 AS lon, position_lat * 180.0 / 2147483648.0 AS lat FROM m)
      SELECT file AS activity_id, CAST(row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS BIGINT) AS seq,
      {q('lon', 6)} AS lon, {q('lat', 6)} AS lat, {q('coalesce(enhanced_altitude, altitude)')} AS ele, CAST(heart_rate AS DOUBLE) AS hr
      FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90""",
)
def _(spark, d):
    p = rec.points_from_records(decoded(spark, d))
    return p.select(
        "activity_id", "seq", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"), r("ele").alias("ele"), "hr"
    )


def _above(low):
    return lambda z: (z["s"] > low) & (z["s"] < float("inf"))


def _walk(level_filter: str, floor: str, x: str, y: str) -> str:
    """Recursive splitting at the farthest vertex, in SQL."""
    t = "greatest(0.0, least(1.0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / nullif(pow(b.x - a.x, 2) + pow(b.y - a.y, 2), 0)))"
    dist = f"sqrt(pow(p.x - (a.x + coalesce({t}, 0.0) * (b.x - a.x)), 2) + pow(p.y - (a.y + coalesce({t}, 0.0) * (b.y - a.y)), 2))"
    return f"""v AS MATERIALIZED (SELECT activity_id, seq, {x} AS x, {y} AS y FROM {level_filter}),
  ends AS (SELECT activity_id, min(seq) AS s0, max(seq) AS s1, {floor} AS floor FROM v GROUP BY 1),
  walk AS (
    SELECT activity_id, s0, s1, CAST(NULL AS BIGINT) AS m, CAST('infinity' AS DOUBLE) AS sig, floor FROM ends
    UNION ALL
    SELECT activity_id, h.s0, h.s1, m, sig, floor FROM (
      SELECT activity_id, s0, s1, best.k AS m, least(cap, best.d) AS sig, floor,
        [{{'s0': s0, 's1': best.k}}, {{'s0': best.k, 's1': s1}}] AS halves
      FROM (
        SELECT o.activity_id, o.s0, o.s1, o.sig AS cap, o.floor,
          max({{'d': {dist}, 'back': -p.seq, 'k': p.seq}}) AS best
        FROM walk o
        JOIN v p ON p.activity_id = o.activity_id AND p.seq > o.s0 AND p.seq < o.s1
        JOIN v a ON a.activity_id = o.activity_id AND a.seq = o.s0
        JOIN v b ON b.activity_id = o.activity_id AND b.seq = o.s1
        GROUP BY o.activity_id, o.s0, o.s1, o.sig, o.floor)
      WHERE least(cap, best.d) > floor) z, unnest(halves) AS u(h))"""


MX = "6378137.0 * radians(lon)"
MY = "6378137.0 * ln(tan(pi() / 4 + radians(greatest(-85.05112878, least(85.05112878, lat))) / 2))"

ORDER_KEY = "WITH RECURSIVE "


@register(
    "simplify_m",
    ORDER_KEY
    + with_flags("").removeprefix("WITH ").rstrip()
    + ", "
    + _walk("flags", "0.0", MX, MY)
    + """, sig AS (SELECT DISTINCT activity_id, m, sig FROM walk WHERE m IS NOT NULL),
  tol AS (SELECT * FROM (VALUES (0, 2048.0), (1, 512.0), (2, 128.0), (3, 32.0), (4, 8.0), (5, 2.0), (6, 0.5)) t(lod, tol)),
  n AS (SELECT activity_id, count(*) AS n, count(DISTINCT seq) AS k FROM v GROUP BY 1)
  SELECT n.activity_id, tol.lod, least(n.n, 2) + count(sig.m) AS vertices, coalesce(sum(sig.m), 0)::BIGINT AS seq_sum
  FROM n CROSS JOIN tol LEFT JOIN sig ON sig.activity_id = n.activity_id AND sig.sig > tol.tol GROUP BY n.activity_id, n.n, tol.lod""",
)
def _(spark, d):
    parts = tr.track_parts(flagged(spark, d)).withColumn("sig", sm.significance_m("geometry"))
    inner = F.transform(
        "sig",
        lambda s, i: F.struct(i.cast("long").alias("i"), s.alias("s")),
    )
    rows = []
    for lod, tol in enumerate(geo.LOD_TOLERANCES_M[:-1]):
        level = F.lit(tol)
        picked = F.filter(inner, _above(level))
        rows.append(
            F.struct(
                F.lit(lod).alias("lod"),
                F.size(sm.level_geometry(F.col("geometry"), F.col("sig"), lod)).cast("long").alias("vertices"),
                F.aggregate(picked, F.lit(0).cast("long"), lambda a, z: a + z["i"]).alias("seq_sum"),
            )
        )
    return parts.select("activity_id", F.explode(F.array(*rows)).alias("x")).select("activity_id", "x.*")


TARGET = 10


@register(
    "simplify_to_target",
    ORDER_KEY
    + with_flags("").removeprefix("WITH ").rstrip()
    + ", "
    + _walk("flags", "0.0", "lon", "lat")
    + f""", sig AS (SELECT DISTINCT activity_id, m, sig FROM walk WHERE m IS NOT NULL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY sig DESC) AS rn FROM sig),
  n AS (SELECT activity_id, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) / 1048576.0 AS step FROM v GROUP BY 1),
  th AS (SELECT n.*, CASE WHEN n <= {TARGET} THEN -1.0 WHEN step = 0 THEN 0.0
      WHEN greatest(1.0, ceil(coalesce(rk.sig, 0.0) / step)) >= 1048576 THEN -1.0
      ELSE greatest(1.0, ceil(coalesce(rk.sig, 0.0) / step)) * step END AS cut
    FROM n LEFT JOIN rk ON rk.activity_id = n.activity_id AND rk.rn = {TARGET} - 1)
  SELECT th.activity_id, CASE WHEN cut < 0 THEN n ELSE 2 + count(sig.m) END AS vertices
  FROM th LEFT JOIN sig ON sig.activity_id = th.activity_id AND sig.sig > th.cut GROUP BY th.activity_id, n, cut""",
)
def _(spark, d):
    lines = sm.simplify_to_target(tr.track_parts(flagged(spark, d)), "geometry", TARGET, "coarse")
    return lines.select("activity_id", F.size("coarse").cast("long").alias("vertices"))


__all__ = ["ACTIVITIES", "ORACLES", "QUERIES", "scalar", "sel", "with_points"]

"""Selections, viewport filters, summaries, tables and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.functions import color, geo, predicates, scalar, text
from pathfold.operators import registry as reg
from pathfold.operators import selection as sel
from pathfold.operators import stats
from pathfold.session import spread

from .base import POINTS, activities, points, q, r, rounded, stamp, table, view, with_activities

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


HIGH_RUNS = "SELECT activity_id FROM activities WHERE lower(sport_type) LIKE '%run%' AND max_elevation_m >= 3000"
BOX = (-104.9, 39.6, -104.3, 40.1)
WRAP = (-104.5, 39.0, -104.8, 41.0)
EMPTY = (10.0, 10.0, 11.0, 11.0)


def sql_contains(box, p=""):
    w, s, e, n = (f"CAST({v} AS DOUBLE)" for v in box)
    op = "AND" if box[0] <= box[2] else "OR"
    return f"(({p}xmin >= {w} {op} {p}xmax <= {e}) AND {p}ymin >= {s} AND {p}ymax <= {n})"


def sql_intersects(box, p=""):
    w, s, e, n = (f"CAST({v} AS DOUBLE)" for v in box)
    op = "AND" if box[0] <= box[2] else "OR"
    return f"(({p}xmax >= {w} {op} {p}xmin <= {e}) AND {p}ymax >= {s} AND {p}ymin <= {n})"


def sql_summary(where: str, clean: bool = False) -> str:
    def f(name):
        return f"coalesce(clean_{name}, {name})" if clean else name

    return f"""SELECT count(*) AS activity_count, {q(f"coalesce(sum({f('distance_m')}), 0.0)")} AS distance_m,
  coalesce(sum(elapsed_seconds), 0.0) AS elapsed_seconds, coalesce(sum(moving_seconds), 0.0) AS moving_seconds,
  {q(f"coalesce(sum({f('elevation_gain_m')}), 0.0)")} AS elevation_gain_m, {q(f"coalesce(sum({f('elevation_loss_m')}), 0.0)")} AS elevation_loss_m,
  {q(f"min({f('min_elevation_m')})")} AS min_elevation_m, {q(f"max({f('max_elevation_m')})")} AS max_elevation_m,
  {q(f"max({f('distance_m')})")} AS max_distance_m, count(DISTINCT CAST(start_time AS DATE)) AS active_days,
  CAST(coalesce(sum(dropped_jump_points), 0) AS BIGINT) AS dropped_jump_points,
  CAST(coalesce(sum(dropped_elevation_points), 0) AS BIGINT) AS dropped_elevation_points,
  strftime(min(start_time), '%Y-%m-%d %H:%M:%S') AS first_activity, strftime(max(start_time), '%Y-%m-%d %H:%M:%S') AS last_activity,
  {q(f"coalesce(sum({f('distance_m')}) / nullif(count(*), 0), 0.0)")} AS average_distance_m,
  {q("coalesce(sum(moving_seconds) / nullif(count(*), 0), 0.0)")} AS average_moving_seconds
  FROM activities WHERE {where}"""


RUNS = "lower(sport_type) LIKE '%run%' AND max_elevation_m >= 3000"


@register("selection_summary", with_activities(sql_summary(RUNS)))
def _(spark, d):
    rows = view(spark, d)
    return rounded(sel.summary(rows, sel.select(spark, HIGH_RUNS + ";")))


@register("summary_viewport", with_activities(sql_summary(sql_contains(BOX))))
def _(spark, d):
    return rounded(sel.summary(activities(spark, d), None, BOX))


@register("summary_clean", with_activities(sql_summary(sql_contains(BOX, "clean_"), True)))
def _(spark, d):
    return rounded(sel.summary(activities(spark, d), None, BOX, True))


@register("summary_empty", with_activities(sql_summary(sql_contains(EMPTY))))
def _(spark, d):
    return rounded(sel.summary(activities(spark, d), None, EMPTY))


@register(
    "family_counts",
    with_activities(
        f"SELECT activity_family AS sport, count(*) AS activity_count FROM activities WHERE {sql_contains(BOX, 'clean_')} GROUP BY 1"
    ),
)
def _(spark, d):
    return sel.family_counts(activities(spark, d), None, BOX, True)


for _name, _box, _clean in (
    ("viewport_intersects", BOX, False),
    ("viewport_intersects_clean", BOX, True),
    ("viewport_antimeridian", WRAP, True),
):

    def _run(spark, d, box=_box, clean=_clean):
        return activities(spark, d).where(predicates.viewport_intersects(box, clean)).select("activity_id")

    register(
        _name,
        with_activities(
            f"SELECT activity_id FROM activities WHERE {sql_intersects(_box, 'clean_' if _clean else '')}"
        ),
    )(_run)


@register(
    "viewport_contains_antimeridian",
    with_activities(f"SELECT activity_id FROM activities WHERE {sql_contains(WRAP, 'clean_')}"),
)
def _(spark, d):
    return activities(spark, d).where(predicates.viewport_contains(WRAP, True)).select("activity_id")


TABLE = f"""SELECT activity_id, name, sport_type, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,
  {q('coalesce(clean_distance_m, distance_m)')} AS distance_m, {q('coalesce(clean_elevation_gain_m, elevation_gain_m)')} AS elevation_gain_m,
  {q('coalesce(clean_max_elevation_m, max_elevation_m)')} AS max_elevation_m, source_url,
  {q('clean_xmin')} AS xmin, {q('clean_ymin')} AS ymin, {q('clean_xmax')} AS xmax, {q('clean_ymax')} AS ymax
  FROM activities WHERE {sql_contains(BOX, 'clean_')} AND {RUNS}"""


@register("activity_table", with_activities(TABLE))
def _(spark, d):
    rows = view(spark, d)
    return rounded(sel.activity_table(rows, sel.select(spark, HIGH_RUNS), BOX, True))


@register(
    "table_sort_topk",
    with_activities(
        f"""SELECT activity_id, {q('distance_m')} AS distance_m, row_number() OVER (ORDER BY coalesce(distance_m, -1) DESC, activity_id) AS place
      FROM activities QUALIFY place <= 100"""
    ),
)
def _(spark, d):
    from pyspark.sql import Window

    top = sel.sort_table(sel.activity_table(activities(spark, d)), "distance").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("distance_m"), "activity_id"))  # 100 rows
    return top.withColumn("place", place.cast("long")).select(
        "activity_id", r("distance_m").alias("distance_m"), "place"
    )


@register(
    "recent_long_selection",
    with_activities(
        "SELECT activity_id FROM activities WHERE distance_m >= 20000 ORDER BY start_time DESC, activity_id LIMIT 100"
    ),
)
def _(spark, d):
    view(spark, d)
    return sel.select(
        spark,
        "SELECT activity_id FROM activities WHERE distance_m >= 20000 ORDER BY start_time DESC, activity_id LIMIT 100;",
    )


@register(
    "selection_dedupe",
    f"""WITH {POINTS}, s AS (SELECT activity_id, hr, cadence FROM pts)
      SELECT activity_id, hr, cadence FROM s
      QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY hr NULLS FIRST, cadence NULLS FIRST) = 1""",
)
def _(spark, d):
    points(spark, d).createOrReplaceTempView("track_rows")
    return sel.dedupe_selection(
        sel.select(spark, "SELECT activity_id, hr, cadence FROM track_rows", ("track_rows",))
    )


@register(
    "selection_ids_bounds",
    with_activities(
        f"SELECT activity_id, point_count, {q('xmin')} AS xmin, {q('ymin')} AS ymin, {q('xmax')} AS xmax, {q('ymax')} AS ymax FROM activities WHERE {RUNS}"
    ),
)
def _(spark, d):
    rows = view(spark, d)
    return rounded(sel.selection_table(rows, sel.select(spark, HIGH_RUNS)))


@register(
    "raw_vertex_estimate",
    with_activities(
        f"SELECT CAST(coalesce(sum(point_count), 0) AS BIGINT) AS vertices FROM activities WHERE {RUNS} AND {sql_intersects(BOX)}"
    ),
)
def _(spark, d):
    rows = view(spark, d)
    return sel.raw_vertex_estimate(rows, sel.select(spark, HIGH_RUNS), BOX)


@register(
    "user_sql_grouping_sets",
    with_activities(
        f"""SELECT activity_family, elevation_source, count(*) AS n, {q('avg(distance_m)')} AS mean_m FROM activities
      GROUP BY GROUPING SETS ((activity_family, elevation_source), (activity_family), ())"""
    ),
)
def _(spark, d):
    view(spark, d)
    return rounded(
        spark.sql(
            """SELECT activity_family, elevation_source, count(*) AS n, avg(distance_m) AS mean_m FROM activities
               GROUP BY GROUPING SETS ((activity_family, elevation_source), (activity_family), ())"""
        )
    )


@register(
    "spatial_key",
    with_activities("SELECT activity_id, spatial_order FROM activities"),
)
def _(spark, d):
    return activities(spark, d).select(
        "activity_id",
        geo.spatial_key((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2).alias(
            "spatial_order"
        ),
    )


R = 6378137.0
LAT = "greatest(-85.05112878, least(85.05112878, lat))"
PLAT = "radians(greatest(-85.051129, least(85.051129, lat)))"


@register(
    "mercator",
    f"""WITH {POINTS} SELECT activity_id, seq, {q(f'{R} * radians(lon)', 2)} AS x, {q(f'{R} * ln(tan(pi() / 4 + radians({LAT}) / 2))', 2)} AS y,
      {q('lon', 6)} AS back_lon, {q('lat', 6)} AS back_lat, {q('(lon + 180) / 360 * 512 * 4096', 4)} AS wx,
      {q(f'(1 - ln(tan({PLAT}) + 1 / cos({PLAT})) / pi()) / 2 * 512 * 4096', 4)} AS wy,
      {q(f'0.5 - ln((1 + sin({PLAT})) / (1 - sin({PLAT}))) / (4 * pi())', 9)} AS uy FROM pts""",
)
def _(spark, d):
    size = 512.0 * 4096
    p = points(spark, d).withColumns({"mx": geo.mercator_x("lon"), "my": geo.mercator_y("lat")})
    return p.select(
        "activity_id",
        "seq",
        r("mx", 2).alias("x"),
        r("my", 2).alias("y"),
        r(geo.inverse_mercator_lon("mx"), 6).alias("back_lon"),
        r(geo.inverse_mercator_lat("my"), 6).alias("back_lat"),
        r(geo.world_x("lon", size), 4).alias("wx"),
        r(geo.world_y("lat", size), 4).alias("wy"),
        r(geo.unit_y("lat"), 9).alias("uy"),
    )


def zooms(spark, d):
    return table(spark, d, "events").select(
        "event_id", (F.lit(2.0) + (F.col("event_id") % 77) * 0.25).alias("zoom"), "value"
    )


ZOOMS = "z AS (SELECT event_id, 2.0 + (event_id % 77) * 0.25 AS zoom, value FROM events)"
MPP = f"(2 * pi() * {R} / (512 * pow(2, zoom)))"


@register(
    "lod_for_zoom",
    f"""WITH {ZOOMS}, m AS (SELECT *, {MPP} AS mpp, {MPP} * 2 AS mpp2 FROM z),
      l AS (SELECT *, {{}} AS lod, {{}} AS lod2 FROM m)
      SELECT event_id, {q('mpp', 6)} AS mpp, CAST(lod AS INTEGER) AS lod, CAST(greatest(0, least(7, lod2 + 1)) AS INTEGER) AS biased FROM l""".format(
        *[
            "CASE "
            + " ".join(f"WHEN {m} >= {t} THEN {i}" for i, t in enumerate((2048, 512, 128, 32, 8, 2, 0.5)))
            + " ELSE 7 END"
            for m in ("mpp", "mpp2")
        ]
    ),
)
def _(spark, d):
    return zooms(spark, d).select(
        "event_id",
        r(geo.metres_per_pixel("zoom"), 6).alias("mpp"),
        geo.requested_lod("zoom").alias("lod"),
        geo.requested_lod("zoom", 2.0, 1).alias("biased"),
    )


def budget_sql(low, high):
    t = "greatest(0.0, least(1.0, (zoom - 7) / 6.0))"
    return f"CAST(floor(({low} + ({high} - {low}) * ({t} * {t} * (3 - 2 * {t}))) / 50000 + 0.5) * 50000 AS BIGINT)"


@register(
    "vertex_budget",
    f"""WITH {ZOOMS} SELECT event_id, {budget_sql(100000.0, 500000.0)} AS low, {budget_sql(200000.0, 750000.0)} AS medium,
      {budget_sql(300000.0, 1000000.0)} AS high, {budget_sql(125000.0, 500000.0)} AS medium_3d FROM z""",
)
def _(spark, d):
    return zooms(spark, d).select(
        "event_id",
        *[geo.scheduled_vertex_budget("zoom", n).alias(n) for n in ("low", "medium", "high")],
        geo.scheduled_vertex_budget("zoom", "medium", True).alias("medium_3d"),
    )


def heat_sql(weight: str, top: str, stops, power: str) -> str:
    n = len(stops) - 1
    pos = f"(pow(CASE WHEN {top} <= 0 THEN 0.0 ELSE ln(1 + {weight}) / ln(1 + {top}) END, {power}) * {n})"
    parts = []
    for k in range(4):
        values = "[" + ", ".join(str(float(s[k])) for s in stops) + "]"
        low = f"list_extract({values}, CAST(floor({pos}) AS BIGINT) + 1)"
        up = f"list_extract({values}, CAST(least({n}, floor({pos}) + 1) AS BIGINT) + 1)"
        parts.append(f"CAST(floor({low} + ({up} - {low}) * ({pos} - floor({pos})) + 0.5) AS BIGINT)")
    return " || ',' || ".join(parts)


def joined(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@register(
    "heat_color",
    f"""SELECT event_id, {heat_sql('value', '500.0', color.PRESETS['sunset'], '1 / 1.7')} AS sunset,
      {heat_sql('value', '500.0', color.PRESETS['ice'], '4.0')} AS ice FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        joined(color.heat_color("value", 500.0)).alias("sunset"),
        joined(color.heat_color("value", 500.0, "ice", 0.1)).alias("ice"),
    )


@register(
    "padded_bounds",
    with_activities(
        f"""SELECT activity_id, {q('greatest(-180.0, clean_xmin - 0.05 * (clean_xmax - clean_xmin))', 7)} AS west,
      {q('greatest(-85.0, clean_ymin - 0.05 * (clean_ymax - clean_ymin))', 7)} AS south,
      {q('least(180.0, clean_xmax + 0.05 * (clean_xmax - clean_xmin))', 7)} AS east,
      {q('least(85.0, clean_ymax + 0.05 * (clean_ymax - clean_ymin))', 7)} AS north,
      {q('greatest(1.0, least(12.0, log2(360 / greatest(clean_xmax - clean_xmin, (clean_ymax - clean_ymin) * 1.6, 0.001)) - 0.8))', 6)} AS zoom FROM activities"""
    ),
)
def _(spark, d):
    box = ["clean_xmin", "clean_ymin", "clean_xmax", "clean_ymax"]
    padded = geo.padded_bounds(*box)
    return activities(spark, d).select(
        "activity_id",
        *[r(c, 7).alias(n) for c, n in zip(padded, ("west", "south", "east", "north"), strict=True)],
        r(geo.fit_zoom(*box), 6).alias("zoom"),
    )


@register(
    "camera_and_strokes",
    f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value - 100 END AS pitch, value * 3 - 700 AS bearing,
        300.0 + event_id % 1200 AS w, 200.0 + event_id % 900 AS h, value FROM events),
      k AS (SELECT *, greatest(320.0, least(w, h)) AS basis FROM s)
      SELECT event_id, {q('greatest(0.0, least(85.0, coalesce(pitch, 30.0)))')} AS pitch,
      {q('(bearing + 180) - 360 * floor((bearing + 180) / 360) - 180')} AS bearing,
      {q('basis * 0.0015 * 2', 6)} AS route, {q('greatest(basis * 0.0015 * 2 * 1.8, basis * 0.0015 * 2 + 1.5)', 6)} AS focus,
      {q('greatest(basis * 0.0015 * 2 * 1.8, basis * 0.0015 * 2 + 1.5) + greatest(1.0, basis * 0.0015)', 6)} AS casing,
      {q('value / 1609.344', 6)} AS mi, {q('value / 1000', 6)} AS km, {q('value * 3.28084', 8)} AS ft FROM k""",
)
def _(spark, d):
    e = F.col("event_id")
    s = table(spark, d, "events").select(
        "event_id",
        F.when(e % 9 != 0, F.col("value") - 100).alias("pitch"),
        (F.col("value") * 3 - 700).alias("bearing"),
        (F.lit(300.0) + e % 1200).alias("w"),
        (F.lit(200.0) + e % 900).alias("h"),
        "value",
    )
    widths = geo.stroke_widths("w", "h", 2.0)
    return s.select(
        "event_id",
        r(geo.normalized_pitch("pitch", 30.0)).alias("pitch"),
        r(geo.normalized_bearing("bearing")).alias("bearing"),
        *[r(widths[n], 6).alias(n) for n in ("route", "focus", "casing")],
        r(geo.distance_in("value", "imperial"), 6).alias("mi"),
        r(geo.distance_in("value", "metric"), 6).alias("km"),
        r(geo.elevation_in("value", "imperial"), 8).alias("ft"),
    )


CELLS = """cells AS (SELECT o_orderkey,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%b %d, %Y, %I:%M:%S %p') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'not a date' ELSE '' END AS t,
    CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN 2 THEN 'NaN'
      WHEN 3 THEN 'inf' WHEN 4 THEN '1_000' ELSE 'x' END AS n,
    o_orderkey % 6 AS k, o_orderkey % 5 AS j, o_totalprice, o_custkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders)"""


@register(
    "parse_cells",
    f"""WITH {CELLS} SELECT o_orderkey, CASE WHEN j < 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts,
      CASE k WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 4 THEN 1000.0 END AS num,
      coalesce(nullif(trim(t), ''), 'Untitled activity') AS name,
      CASE WHEN o_orderkey % 4 = 0 THEN sha256('strava:' || t || ':' || o_orderpriority) ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM cells""",
)
def _(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    cells = table(spark, d, "orders").withColumns(
        {
            "t": F.when(k % 5 == 0, F.date_format(day, "MMM dd, yyyy, hh:mm:ss a"))
            .when(k % 5 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k % 5 == 2, F.date_format(day, "yyyy-MM-dd"))
            .when(k % 5 == 3, "not a date")
            .otherwise(""),
            "n": F.when(k % 6 == 0, F.col("o_totalprice").cast("string"))
            .when(k % 6 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")))
            .when(k % 6 == 2, "NaN")
            .when(k % 6 == 3, "inf")
            .when(k % 6 == 4, "1_000")
            .otherwise("x"),
            "source_id": F.when(k % 4 != 0, k.cast("string")),
        }
    )
    return cells.select(
        "o_orderkey",
        stamp(scalar.parse_activity_timestamp("t")).alias("ts"),
        scalar.parse_number("n").alias("num"),
        scalar.first_nonempty("t", default="Untitled activity").alias("name"),
        scalar.activity_id("source_id", "t", "o_orderpriority").alias("id"),
    )


SPORT_NAMES = (
    "Run", "TRAIL RUN", "E-Bike Ride", "Indoor Cycling", "Nordic Ski", "Snowboard", "Hike", "Walk",
    "Rowing", "Swim", "Stand Up Paddling", "Canoeing", "Windsurf", "Yoga",
)


@register(
    "activity_family",
    f"""WITH s AS (SELECT event_id, list_extract({list(SPORT_NAMES)!r}, CAST(event_id % 14 + 1 AS BIGINT)) AS sport FROM events), l AS (SELECT *, lower(sport) AS x FROM s)
      SELECT event_id, sport, CASE WHEN contains(x, 'run') THEN 'run' WHEN contains(x, 'ride') OR contains(x, 'cycling') OR contains(x, 'bike') THEN 'ride'
      WHEN contains(x, 'ski') OR contains(x, 'snowboard') THEN 'ski' WHEN contains(x, 'walk') OR contains(x, 'hike') THEN 'foot'
      WHEN contains(x, 'kayak') OR contains(x, 'row') OR contains(x, 'swim') OR contains(x, 'surf') OR contains(x, 'water') OR contains(x, 'paddl') OR contains(x, 'canoe') THEN 'water' ELSE 'other' END AS family FROM l""",
)
def _(spark, d):
    sport = F.element_at(F.array(*[F.lit(s) for s in SPORT_NAMES]), (F.col("event_id") % 14 + 1).cast("int"))
    return (
        table(spark, d, "events")
        .select("event_id", sport.alias("sport"))
        .withColumn("family", scalar.activity_family("sport"))
    )


BLANK = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
REDACT = (
    r"regexp_replace(regexp_replace(regexp_replace({c}, "
    rf"'(?i)(authorization|bearer|token|secret|password|credential|access[_-]?key)[=: ]+[^{BLANK},;]+', '\1=[redacted]', 'g'), "
    rf"'(?i)https?://[^{BLANK})]+', '[url]', 'g'), "
    rf"'(?i)(?:file://)?/?(?:Users|home)/[^{BLANK})]+', '[local-path]', 'g')"
)
PLANTED = "'see /home/' || doc_id || '/a.txt token: t' || doc_id || ' ' || text || ' https://x.example/' || doc_id"


@register(
    "redact_text",
    f"""WITH t AS (SELECT doc_id, {PLANTED} AS body FROM documents), m AS (SELECT doc_id, {REDACT.replace('{c}', 'body')} AS clean FROM t)
      SELECT doc_id, md5(clean) AS digest, CAST((length(clean) - length(replace(clean, '[redacted]', ''))) / 10 AS BIGINT) AS secrets, length(clean) AS n FROM m""",
)
def _(spark, d):
    planted = F.expr(PLANTED)
    clean = F.col("clean")
    return (
        spread(table(spark, d, "documents").select("doc_id", "text"))
        .select("doc_id", text.redact(planted).alias("clean"))
        .select(
            "doc_id",
            F.md5("clean").alias("digest"),
            ((F.length(clean) - F.length(F.replace(clean, F.lit("[redacted]"), F.lit("")))) / 10)
            .cast("long")
            .alias("secrets"),
            F.length(clean).cast("long").alias("n"),
        )
    )


@register(
    "redact_conversations",
    f"SELECT conv_id, turn, md5({REDACT.replace('{c}', 'text')}) AS digest FROM conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(text.redact("text")).alias("digest")
    )


ERRORS = r"""CASE page_id % 4 WHEN 0 THEN 'DuckDB error:' || chr(10) || 'Binder Error: ' || url WHEN 1 THEN 'Out of Memory Error ' || url
  WHEN 2 THEN 'Files (1):' || chr(10) || 'SQL:' || chr(10) || 'DuckDB error: syntax error at password=' || page_id || chr(10) || 'LINE 1' ELSE 'NetworkError' END"""


@register(
    "classify_error",
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'renderViewport' ELSE 'execute' END AS op, {ERRORS} AS msg FROM pages),
      l AS (SELECT *, list_filter(string_split(trim(list_last(string_split(msg, 'DuckDB error:')), ' ' || chr(10)), chr(10)), lambda x: x <> '') AS lines FROM p)
      SELECT page_id, CASE WHEN op = 'execute' AND regexp_matches(msg, '(?i)(Parser Error|Binder Error|Catalog Error|syntax error)') THEN 'query' ELSE 'unexpected' END AS kind,
      {REDACT.replace('{c}', 'lines[1]')} AS line FROM l""",
)
def _(spark, d):
    p = table(spark, d, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, "renderViewport").otherwise("execute").alias("op"),
        F.expr(ERRORS).alias("msg"),
    )
    return p.select(
        "page_id",
        text.classify_error("op", "msg").alias("kind"),
        text.first_error_line("msg", limit=None).alias("line"),
    )


TRACE = """'Traceback ' || html || chr(10) || CASE WHEN page_id % 2 = 0 THEN '  {"column": "a",' || chr(10) || '   "error": "bad value ' || page_id || '",' || chr(10) || '  }' ELSE 'ValueError: ' || url END"""


@register(
    "failure_detail",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'bad value ' || page_id ELSE 'ValueError: ' || url END AS detail FROM pages""",
)
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.failure_detail(F.expr(TRACE)).alias("detail")
    )


@register(
    "artifact_paths",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'builds/b' || o_custkey || '/activities/x.parquet' WHEN 1 THEN '/activities/x'
        WHEN 2 THEN 'activities/../x' ELSE 'render/x' END AS path,
        CASE WHEN o_orderkey % 3 = 0 THEN 'B ' || o_orderkey ELSE 'schema-1.6.0-' || o_orderkey END AS build FROM orders)
      SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'activities/x.parquet' END AS path, o_orderkey % 3 <> 0 AS valid_build FROM p""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("builds/b"), "o_custkey", F.lit("/activities/x.parquet")))
        .when(k % 4 == 1, "/activities/x")
        .when(k % 4 == 2, "activities/../x")
        .otherwise("render/x")
    )
    build = F.when(k % 3 == 0, F.concat(F.lit("B "), k)).otherwise(F.concat(F.lit("schema-1.6.0-"), k))
    return table(spark, d, "orders").select(
        "o_orderkey",
        scalar.normalize_artifact_path(path, "activities").alias("path"),
        scalar.valid_build_id(build).alias("valid_build"),
    )


@register(
    "validation_rules",
    with_activities(
        """SELECT 'broken_long' AS rule, count(*) FILTER (WHERE NOT distance_m < 100000) AS violations FROM activities
      UNION ALL SELECT 'point_count_at_least_2', count(*) FILTER (WHERE point_count < 2) FROM activities
      UNION ALL SELECT 'xmax_range', count(*) FILTER (WHERE NOT xmax BETWEEN -180 AND 180) FROM activities
      UNION ALL SELECT 'counts_balance', count(*) FILTER (WHERE clean_point_count + dropped_jump_points + dropped_elevation_points <> point_count) FROM activities"""
    ),
)
def _(spark, d):
    from pathfold.schema import SCALAR_RULES

    names = ("point_count_at_least_2", "xmax_range", "counts_balance")
    rules = {"broken_long": "distance_m < 100000", **{n: SCALAR_RULES[n] for n in names}}
    return stats.rule_violations(activities(spark, d), rules)


@register(
    "registry_patterns",
    """WITH i AS (SELECT c_custkey, md5(c_name) AS h, c_custkey % 4 AS k, c_acctbal FROM customer),
      j AS (SELECT c_custkey, CASE k WHEN 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
        WHEN 1 THEN substr(h, 1, 8) WHEN 2 THEN upper(h) ELSE 'A' || h || '!' END AS id FROM i)
      SELECT c_custkey, regexp_full_match(id, '(?i)[0-9a-f-]{36}') AS map_id, regexp_full_match(id, '[a-z0-9]{8}') AS slug, regexp_full_match(id, '(?i)[0-9a-f-]{16,64}') AS subject FROM j""",
)
def _(spark, d):
    h, k = F.col("h"), F.col("c_custkey") % 4
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    ids = table(spark, d, "customer").withColumn("h", F.md5("c_name")).select(
        "c_custkey",
        F.when(k == 0, dashed)
        .when(k == 1, F.substring(h, 1, 8))
        .when(k == 2, F.upper(h))
        .otherwise(F.concat(F.lit("A"), h, F.lit("!")))
        .alias("id"),
    )
    return ids.select("c_custkey", *[reg.matches("id", p).alias(p) for p in ("map_id", "slug", "subject")])

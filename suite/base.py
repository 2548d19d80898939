"""Shared inputs: the derived activities in Spark and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.operators import activities as act
from pathfold.operators import tracks as tr
from pathfold.session import use_utc
from pathfold.sources.event_tracks import event_points, event_records


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return event_points(spark, d)


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return tr.clean_track(points(spark, d))


def records(p: DataFrame) -> DataFrame:
    return event_records(p).withColumns(
        {"source_type": F.lit("gpx"), "source_checksum": F.sha2("activity_id", 256)}
    )


def activities(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    good, _ = act.split_accepted(tr.track_summary(tr.clean_track(p)))
    return act.describe_activities(good, records(p))


def view(spark: SparkSession, d: str, clean: bool = False) -> DataFrame:
    rows = activities(spark, d)
    if clean:
        rows = act.clean_view(rows)
    rows.createOrReplaceTempView("activities")
    return rows


def r(c, digits: int = 3) -> Column:
    """Rounded for comparison between engines; adding zero removes a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stamp(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(12742000.0 * asin(sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + "
        f"cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2))))"
    )


def q(x: str, digits: int = 3) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


POINTS = """
ev AS (
  SELECT event_id AS e, user_id AS u, value AS v,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week
  FROM events),
pts AS (
  SELECT u || '-' || week AS activity_id, u, week, e,
    CAST(row_number() OVER (PARTITION BY u, week ORDER BY e) - 1 AS BIGINT) AS seq,
    CAST(week * 604800 + 10 * (row_number() OVER (PARTITION BY u, week ORDER BY e) - 1) AS DOUBLE) AS t,
    CASE WHEN e % 41 = 0 THEN 0.0 ELSE -105.0 + (u % 50) * CAST(0.02 AS DOUBLE) + (e % 97) * CAST(0.00005 AS DOUBLE) END AS lon,
    CASE WHEN e % 41 = 0 THEN 0.0 ELSE 39.5 + (u % 40) * CAST(0.02 AS DOUBLE) + (e % 89) * CAST(0.00005 AS DOUBLE) END AS lat,
    CASE WHEN e % 53 = 0 THEN NULL WHEN e % 37 = 0 THEN 3500.0 ELSE 1500.0 + v / 10 END AS ele,
    CASE WHEN e % 11 <> 0 THEN CAST(100 + e % 80 AS DOUBLE) END AS hr,
    CASE WHEN e % 13 <> 0 THEN CAST(60 + e % 40 AS DOUBLE) END AS cadence,
    CASE WHEN e % 3 = 0 THEN CAST(150 + e % 200 AS DOUBLE) END AS power
  FROM ev)"""

FLAGS = f"""{POINTS},
nb AS (
  SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t) OVER w AS pt, lag(ele) OVER w AS pele,
    lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(t) OVER w AS nt, lead(ele) OVER w AS nele
  FROM pts WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
lg AS (
  SELECT *, {hav('plon', 'plat', 'lon', 'lat')} AS leg_in, {hav('lon', 'lat', 'nlon', 'nlat')} AS leg_out,
    {hav('plon', 'plat', 'nlon', 'nlat')} AS leg_past,
    CASE WHEN t > pt THEN t - pt END AS s_in, CASE WHEN nt > t THEN nt - t END AS s_out,
    CASE WHEN nt > pt THEN nt - pt END AS s_past
  FROM nb),
fl AS (
  SELECT *, coalesce(leg_in, 0.0) AS leg_m,
    coalesce(plon IS NOT NULL AND nlon IS NOT NULL
      AND leg_in > 1000 AND (CASE WHEN s_in IS NULL THEN leg_in > 20000 ELSE leg_in / s_in > 80 END)
      AND leg_out > 1000 AND (CASE WHEN s_out IS NULL THEN leg_out > 20000 ELSE leg_out / s_out > 80 END)
      AND NOT (leg_past > 1000 AND (CASE WHEN s_past IS NULL THEN leg_past > 20000 ELSE leg_past / s_past > 80 END)),
      false) AS dropped_jump,
    coalesce(plon IS NOT NULL AND nlon IS NOT NULL AND abs(ele - pele) > 150 AND abs(ele - nele) > 150
      AND (ele - pele) * (ele - nele) > 0 AND abs(nele - pele) < 100
      AND abs(ele - pele) > coalesce(10 * s_in, 500) AND abs(ele - nele) > coalesce(10 * s_out, 500),
      false) AS spike
  FROM lg),
flags AS (
  SELECT *, spike AND NOT dropped_jump AS dropped_elevation,
    NOT dropped_jump AND NOT spike AS clean
  FROM fl)"""

SUMMARY = f"""{FLAGS},
kept AS (
  SELECT *,
    last_value(ele IGNORE NULLS) OVER b AS pe,
    last_value(CASE WHEN clean THEN lon END IGNORE NULLS) OVER b AS clon,
    last_value(CASE WHEN clean THEN lat END IGNORE NULLS) OVER b AS clat,
    last_value(CASE WHEN clean THEN ele END IGNORE NULLS) OVER b AS ce
  FROM flags
  WINDOW b AS (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
summary AS (
  SELECT activity_id, any_value(u) AS u, any_value(week) AS week,
    min(t) AS t0, max(t) AS t1, count(*) AS point_count, count(ele) AS elevations,
    count(*) FILTER (WHERE clean) AS clean_point_count,
    count(*) FILTER (WHERE dropped_jump) AS dropped_jump_points,
    count(*) FILTER (WHERE dropped_elevation) AS dropped_elevation_points,
    sum(leg_m) AS track_distance_m,
    coalesce(sum(CASE WHEN clean THEN {hav('clon', 'clat', 'lon', 'lat')} END), 0.0) AS clean_distance_m,
    CASE WHEN count(ele) > 1 THEN coalesce(sum(greatest(ele - pe, 0.0)) FILTER (WHERE ele - pe IS NOT NULL), 0.0) END AS track_gain_m,
    CASE WHEN count(ele) > 1 THEN coalesce(sum(greatest(pe - ele, 0.0)) FILTER (WHERE ele - pe IS NOT NULL), 0.0) END AS track_loss_m,
    CASE WHEN count(ele) FILTER (WHERE clean) > 1 THEN coalesce(sum(greatest(ele - ce, 0.0)) FILTER (WHERE clean AND ele - ce IS NOT NULL), 0.0) END AS clean_elevation_gain_m,
    CASE WHEN count(ele) FILTER (WHERE clean) > 1 THEN coalesce(sum(greatest(ce - ele, 0.0)) FILTER (WHERE clean AND ele - ce IS NOT NULL), 0.0) END AS clean_elevation_loss_m,
    min(ele) AS min_elevation, max(ele) AS max_elevation,
    min(ele) FILTER (WHERE clean) AS clean_min_elevation, max(ele) FILTER (WHERE clean) AS clean_max_elevation,
    min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax,
    min(lon) FILTER (WHERE clean) AS clean_xmin, min(lat) FILTER (WHERE clean) AS clean_ymin,
    max(lon) FILTER (WHERE clean) AS clean_xmax, max(lat) FILTER (WHERE clean) AS clean_ymax
  FROM kept GROUP BY activity_id)"""


def morton(lon: str, lat: str) -> str:
    """Interleave 16 bits per axis, bit by bit."""
    x = f"CAST(trunc((({lon}) + 180) / 360 * 65535) AS BIGINT)"
    y = f"CAST(trunc((({lat}) + 90) / 180 * 65535) AS BIGINT)"
    terms = [f"((({x}) >> {b}) & 1) << {2 * b}" for b in range(16)]
    terms += [f"((({y}) >> {b}) & 1) << {2 * b + 1}" for b in range(16)]
    return "(" + " + ".join(f"({t})" for t in terms) + ")"


ACTIVITIES = f"""{SUMMARY},
activities AS (
  SELECT s.*, CASE WHEN n % 9 <> 0 THEN activity_id END AS source_activity_id,
    'activities/' || activity_id || '.gpx' AS source_filename, 'gpx' AS source_type,
    sha256(activity_id) AS source_checksum, 'Activity ' || activity_id AS name, sport_type,
    TIMESTAMP '2024-01-01' + to_seconds(t0) AS start_time,
    TIMESTAMP '2024-01-01' + to_seconds(t1) AS end_time,
    strftime(DATE '2024-01-01' + CAST(week * 7 AS INTEGER), '%Y-%m-%d') AS original_start_time,
    CASE WHEN n % 9 <> 0 THEN 'https://www.strava.com/activities/' || activity_id END AS source_url,
    CASE WHEN track_distance_m > 0 THEN track_distance_m ELSE (n % 50) * 1000.0 END AS distance_m,
    t1 - t0 AS elapsed_seconds,
    CASE WHEN u % 5 > 1 AND n % 3000 <> 0 THEN CAST(n % 3000 AS DOUBLE) ELSE t1 - t0 END AS moving_seconds,
    coalesce(track_gain_m, greatest(0.0, (n % 7 - 1) * 10.0)) AS elevation_gain_m,
    coalesce(track_loss_m, greatest(0.0, (n % 5 - 1) * 10.0)) AS elevation_loss_m,
    coalesce(min_elevation, 100.0) AS min_elevation_m, coalesce(max_elevation, 200.0) AS max_elevation_m,
    clean_min_elevation AS clean_min_elevation_m, clean_max_elevation AS clean_max_elevation_m,
    CASE WHEN track_distance_m > 0 THEN 'track' ELSE 'csv' END AS distance_source,
    CASE WHEN u % 5 = 0 THEN 'track' ELSE 'csv' END AS moving_time_source,
    CASE WHEN elevations > 0 THEN 'track' ELSE 'csv' END AS elevation_source,
    CASE WHEN sport_type ILIKE '%run%' THEN 'run' WHEN sport_type = 'Ride' THEN 'ride'
      WHEN sport_type = 'Walk' THEN 'foot' WHEN sport_type = 'Kayaking' THEN 'water' ELSE 'other' END AS activity_family,
    {morton('(xmin + xmax) / 2', '(ymin + ymax) / 2')} AS spatial_order
  FROM (SELECT *, u * 7 + week AS n,
      list_extract(['Run', 'Trail Run', 'Ride', 'Walk', 'Kayaking', 'Workout'], CAST(u % 6 + 1 AS BIGINT)) AS sport_type
    FROM summary WHERE point_count >= 2) s)"""


def with_activities(body: str) -> str:
    return f"WITH {ACTIVITIES}\n{body}"


def with_flags(body: str) -> str:
    return f"WITH {FLAGS}\n{body}"


def with_points(body: str) -> str:
    return f"WITH {POINTS}\n{body}"

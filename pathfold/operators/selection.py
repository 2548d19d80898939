"""SQL selections over ``activities`` and the summaries and tables read from them."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Bounds, viewport_contains, viewport_intersects
from ..functions.scalar import clean_or_raw, dimension_kind

UNIVERSAL = "select activity_id from activities"


def normalize_sql(sql: str) -> str:
    return re.sub(r";+\s*$", "", sql.strip())


def is_universal(sql: str) -> bool:
    """Selecting every activity needs no selection join."""
    return " ".join(sql.split()).lower() == UNIVERSAL


APPROVED = ("activities", "activities_full")
CATALYST = "org.apache.spark.sql.catalyst"
REFUSED = ("reflect", "java_method", "try_reflect")
TABLE_FUNCTIONS = ("explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple")


def _inside(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_query(spark: SparkSession, sql: str, relations: tuple[str, ...] = APPROVED) -> None:
    """Raise unless the query reads approved relations only and calls no JVM method.

    The parsed plan is walked, subqueries and CTEs included, before anything is resolved. A CTE's
    name counts where the query can see it: in the CTEs after it (in itself, if it is recursive)
    and in the body of its WITH. Functions go by one name, table functions are on a list.
    """
    gateway = spark.sparkContext._gateway
    queue = [(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(name.lower() for name in relations))]
    while queue:
        node, known = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for named in _inside(node.cteRelations()):
                seen = known | {named._1().lower()}
                queue.append((named._2(), seen if node.allowRecursion() else known))
                known = seen
            queue += [(child, known) for child in _inside(node.children())]
            continue
        if kind == "UnresolvedRelation":
            name = ".".join(_inside(node.multipartIdentifier())).lower()
            if name not in known:
                raise ValueError(f"a selection may not read {name}")
        elif kind == "UnresolvedFunction":
            parts = [part.lower() for part in _inside(node.nameParts())]
            if len(parts) > 1 or parts[0] in REFUSED:
                raise ValueError(f"a selection may not call {'.'.join(parts)}")
        elif kind in ("UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = node.name().mkString(".") if kind == "UnresolvedTableValuedFunction" else node.name().unquotedString()
            if name.lower() not in TABLE_FUNCTIONS:
                raise ValueError(f"a selection may not call the table function {name}")
        elif "UnresolvedIdentifier" in kind:
            raise ValueError("a selection names its relations as they are")
        below = _inside(node.children())
        if is_instance_of(gateway, node, f"{CATALYST}.plans.logical.LogicalPlan"):
            below += _inside(node.expressions()) + _inside(node.innerChildren().toSeq())
        elif is_instance_of(gateway, node, f"{CATALYST}.expressions.SubqueryExpression"):
            below.append(node.plan())
        queue += [(child, known) for child in below]


def select(spark: SparkSession, sql: str, relations: tuple[str, ...] = APPROVED) -> DataFrame:
    """Run a selection; it must be a query on ``relations`` that returns ``activity_id``."""
    wrapped = f"SELECT * FROM (\n{normalize_sql(sql)}\n)"
    check_query(spark, wrapped, relations)
    selected = spark.sql(wrapped)
    if "activity_id" not in selected.columns:
        raise ValueError("SQL must return an activity_id column")
    return selected


def dedupe_selection(selected: DataFrame) -> DataFrame:
    """One row per activity: the smallest by all other columns, so the choice is repeatable."""
    others = [c for c in selected.columns if c != "activity_id"]
    if not others:
        return selected.distinct()
    return (
        selected.groupBy("activity_id")
        .agg(F.min(F.struct(*others)).alias("_row"))
        .select("activity_id", "_row.*")
        .select(*selected.columns)
    )


def selection_table(activities: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids with raw size and bounds."""
    return semi(activities, selected).select(
        "activity_id", "point_count", "xmin", "ymin", "xmax", "ymax"
    ).distinct()


def semi(rows: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Rows of selected activities; no join when everything is selected."""
    if selected is None:
        return rows
    return rows.join(selected.select("activity_id"), "activity_id", "left_semi")


def _scope(
    activities: DataFrame, selected: DataFrame | None, bounds: Bounds | None, clean: bool
) -> DataFrame:
    return semi(activities.where(viewport_contains(bounds, clean)), selected)


def summary(
    activities: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    """One row of totals over the selected activities contained in the viewport."""

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(name)

    def field(name: str) -> Column:
        return clean_or_raw(name, clean)

    stamp = "yyyy-MM-dd HH:mm:ss"
    out = _scope(activities, selected, bounds, clean).agg(
        F.count(F.lit(1)).alias("activity_count"),
        total(field("distance_m"), "distance_m"),
        total(F.col("elapsed_seconds"), "elapsed_seconds"),
        total(F.col("moving_seconds"), "moving_seconds"),
        total(field("elevation_gain_m"), "elevation_gain_m"),
        total(field("elevation_loss_m"), "elevation_loss_m"),
        F.min(field("min_elevation_m")).alias("min_elevation_m"),
        F.max(field("max_elevation_m")).alias("max_elevation_m"),
        F.max(field("distance_m")).alias("max_distance_m"),
        F.countDistinct(F.to_date("start_time")).alias("active_days"),
        total(F.col("dropped_jump_points"), "dropped_jump_points"),
        total(F.col("dropped_elevation_points"), "dropped_elevation_points"),
        F.date_format(F.min("start_time"), stamp).alias("first_activity"),
        F.date_format(F.max("start_time"), stamp).alias("last_activity"),
    )
    return out.withColumns(
        {
            "average_distance_m": per_activity("distance_m"),
            "average_moving_seconds": per_activity("moving_seconds"),
        }
    )


def per_activity(name: str) -> Column:
    """Average over the activity count, 0 when there is none."""
    return F.coalesce(F.try_divide(F.col(name), F.col("activity_count")), F.lit(0.0))


def family_counts(
    activities: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    return (
        _scope(activities, selected, bounds, clean)
        .groupBy(F.col("activity_family").alias("sport"))
        .agg(F.count(F.lit(1)).alias("activity_count"))
        .orderBy(F.desc("activity_count"), "sport")
    )


def activity_table(
    activities: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    p = "clean_" if clean else ""
    return _scope(activities, selected, bounds, clean).select(
        "activity_id",
        "name",
        "sport_type",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        clean_or_raw("distance_m", clean).alias("distance_m"),
        clean_or_raw("elevation_gain_m", clean).alias("elevation_gain_m"),
        clean_or_raw("max_elevation_m", clean).alias("max_elevation_m"),
        "source_url",
        *[F.col(f"{p}{b}").alias(b) for b in ("xmin", "ymin", "xmax", "ymax")],
    )


SORT_KEYS = {
    "name": ("name", None),
    "sport": ("sport_type", None),
    "date": ("start_time", ""),
    "distance": ("distance_m", -1.0),
    "gain": ("elevation_gain_m", -1.0),
    "maximum": ("max_elevation_m", -1.0),
}


def sort_table(table: DataFrame, key: str, descending: bool | None = None) -> DataFrame:
    """Order a table by one of its headings; ties by id so the order is repeatable."""
    column, missing = SORT_KEYS[key]
    if descending is None:
        descending = key not in ("name", "sport")
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    return table.orderBy(value.desc() if descending else value.asc(), "activity_id")


def route_metadata(activities: DataFrame, activity_id: str, clean: bool = False) -> DataFrame:
    return activities.where(F.col("activity_id") == activity_id).select(
        "activity_id",
        "name",
        "sport_type",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        clean_or_raw("distance_m", clean).alias("distance_m"),
        clean_or_raw("elevation_gain_m", clean).alias("elevation_gain_m"),
        clean_or_raw("max_elevation_m", clean).alias("max_elevation_m"),
        "source_url",
    ).limit(1)


def dimension_columns(selected: DataFrame) -> dict[str, str]:
    """Eligible extra columns of a selection and their kind, from the schema alone."""
    kinds = {
        f.name: dimension_kind(f.dataType.simpleString())
        for f in selected.schema.fields
        if f.name != "activity_id"
    }
    return {n: k for n, k in kinds.items() if k}


def vertex_estimate(
    render: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    """Exact vertex totals of every level in one pass over the count columns."""
    count = F.col("clean_vertex_count" if clean else "vertex_count")
    return (
        semi(render.where(viewport_intersects(bounds, clean)), selected)
        .groupBy("lod")
        .agg(F.sum(count).alias("vertices"))
    )


def activity_vertex_counts(
    render: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    count = F.col("clean_vertex_count" if clean else "vertex_count")
    return (
        semi(render.where(viewport_intersects(bounds, clean)), selected)
        .groupBy("activity_id")
        .agg(F.coalesce(F.sum(count), F.lit(0)).alias("vertex_count"))
    )


def raw_vertex_estimate(
    activities: DataFrame, selected: DataFrame | None = None, bounds: Bounds | None = None
) -> DataFrame:
    return semi(activities.where(viewport_intersects(bounds)), selected).agg(
        F.coalesce(F.sum("point_count"), F.lit(0)).alias("vertices")
    )

"""Choosing a level of detail and fetching it within a vertex budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import VERTEX_BUDGETS_2D, VERTEX_BUDGETS_3D, haversine_m
from ..functions.predicates import Bounds, viewport_intersects
from ..operators import selection as sel
from ..operators.tracks import GAP_M


@dataclass(frozen=True)
class LodPlan:
    lod: int
    vertices: int


def clamp_lod(available: Sequence[int], wanted: int) -> int:
    """Finest available level not finer than the wanted one, else the coarsest."""
    levels = sorted(available)
    if not levels:
        raise ValueError("dataset has no render pyramid")
    return max((v for v in levels if v <= wanted), default=levels[0])


def plan_lod(
    estimates: Mapping[int, int],
    fidelity: int,
    budget: int,
    fill: bool = False,
    start: int | None = None,
) -> LodPlan:
    """Level to render, from the exact vertex count of every level (at most eight numbers).

    The plan is the finest level reachable from the start without a level above the budget in
    between; when the start itself is over budget, the finest coarser level that fits, or the
    coarsest.  Levels finer than ``fidelity`` are considered only to fill the budget.
    """
    levels = sorted(v for v in estimates if fill or v <= fidelity)
    if not levels:
        raise ValueError("no available render level")
    begin = clamp_lod(levels, fidelity if start is None else start)
    at_or_below = [v for v in levels if v <= begin]
    chosen = next((v for v in reversed(at_or_below) if estimates[v] <= budget), levels[0])
    for level in levels[levels.index(chosen) + 1 :]:
        if estimates[chosen] > budget or estimates[level] > budget:
            break
        chosen = level
    return LodPlan(chosen, estimates[chosen])


def plan_resolutions(
    estimates: Mapping[int, int], fidelity: int, fill: bool = False, three_d: bool = False
) -> dict[str, LodPlan]:
    budgets = VERTEX_BUDGETS_3D if three_d else VERTEX_BUDGETS_2D
    return {n: plan_lod(estimates, fidelity, top, fill) for n, (_, top) in budgets.items()}


def level_estimates(
    render: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> dict[int, int]:
    """Vertices per level; a level without a visible route counts 0."""
    rows = sel.vertex_estimate(render, selected, bounds, clean).collect()  # one row per level
    found = {r.lod: int(r.vertices) for r in rows}
    return {lod: found.get(lod, 0) for lod in range(8)}


def fetch_lines(
    level: DataFrame,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    clean: bool = False,
) -> DataFrame:
    """(activity_id, part, geometry, carried) of the visible selected routes of one level.

    ``carried``: the line starts with the last vertex of an earlier part.
    """
    prefix, name = ("clean_", "geometry_clean") if clean else ("", "geometry")
    line = F.col(name)
    return sel.semi(level.where(viewport_intersects(bounds, clean)), selected).select(
        "activity_id", "part", line.alias("geometry"), (F.size(line) > F.col(f"{prefix}vertex_count")).alias("carried")
    )


def line_vertices(lines: DataFrame) -> DataFrame:
    """Lines to long vertices (activity_id, part, at, lon, lat); no shuffle."""
    return lines.select("activity_id", "part", F.posexplode("geometry").alias("at", "p")).select(
        "activity_id", "part", "at", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


def line_edges(lines: DataFrame) -> DataFrame:
    """Consecutive vertex pairs inside each stored line (activity_id, seq, x0, y0, x1, y1)."""
    g = F.col("geometry")
    pairs = F.zip_with(
        F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))),
        F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))),
        lambda a, b: F.struct(
            a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")
        ),
    )
    return lines.select("activity_id", "part", F.posexplode(pairs).alias("at", "e")).select(
        "activity_id", (F.col("part") * (1 << 24) + F.col("at")).alias("seq"), "e.*"
    )


def line_segments(lines: DataFrame, gap_m: float = GAP_M) -> DataFrame:
    """Split each line at long legs: (activity_id, part, segment_no, positions, continues).

    A line is one bounded array, so the split folds it in place without a shuffle.  A line that
    starts with a carried vertex goes on with the segment before (``continues``), unless the leg
    from it is a long one; then the vertex alone makes no segment.
    """
    g = F.col("geometry")
    carried = F.col("carried") if "carried" in lines.columns else F.lit(False)
    breaks = F.filter(
        F.sequence(F.lit(1), F.size(g) - 1),
        lambda i: haversine_m(g[i - 1][0], g[i - 1][1], g[i][0], g[i][1]) > gap_m,
    )
    breaks = F.when(F.size(g) > 1, breaks).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(0)), breaks)
    ends = F.concat(breaks, F.array(F.size(g)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.slice(g, a + 1, b - a))
    split = lines.where(F.size(g) > 0).select(
        "activity_id", "part", carried.alias("carried"), F.posexplode(pieces).alias("segment_no", "positions")
    )
    first = F.col("carried") & (F.col("segment_no") == 0)
    return split.where(~(first & (F.size("positions") == 1))).select(
        "activity_id", "part", "segment_no", "positions", first.alias("continues")
    )


@dataclass(frozen=True)
class Viewport:
    """What a fetch returned: the plan, its counts, and the segments."""

    plan: LodPlan
    resolutions: dict[str, LodPlan]
    candidate_routes: int
    raw_vertices: int
    budget: int
    segments: DataFrame


def render_viewport(
    render: DataFrame,
    activities: DataFrame,
    fidelity: int,
    budget: int,
    selected: DataFrame | None = None,
    bounds: Bounds | None = None,
    visible: Bounds | None = None,
    clean: bool = False,
    fill: bool = False,
    start: int | None = None,
    three_d: bool = False,
) -> Viewport:
    """Estimate every level at once, plan, then read one level and split its lines."""
    estimates = level_estimates(render, selected, bounds, clean)
    plan = plan_lod(estimates, fidelity, budget, fill, start)
    level = render.where(F.col("lod") == plan.lod)
    routes = sel.activity_vertex_counts(level, selected, bounds, clean).count()
    raw = sel.raw_vertex_estimate(activities, selected, visible or bounds).first()[0]
    segments = line_segments(fetch_lines(level, selected, bounds, clean))
    return Viewport(
        plan, plan_resolutions(estimates, fidelity, fill, three_d), routes, int(raw), budget, segments
    )


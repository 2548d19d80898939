"""Line simplification by vertex significance.

Douglas-Peucker always splits a line at its farthest vertex, whatever the tolerance; the
tolerance only decides where to stop.  So every vertex has one *significance*: the smallest
farthest-distance on the way down to it.  A tolerance keeps the vertices above it, and any
number of levels or vertex targets come from one pass over the line.

Lines of one part are measured inside an Arrow UDF.  A track of several parts is split by
DataFrame rounds (``long_significance``) until its pieces are small enough for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import LOD_TOLERANCES_M, mercator_x, mercator_y
from ..session import cut_lineage
from .ranks import top_per_key
from .spatial import point_segment_distance
from .tracks import CHUNK_POINTS

BISECTION_STEPS = 20
SIG = T.ArrayType(T.DoubleType())
RUN_VERTICES = 1 << 17


def batch_significance(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Significance of every vertex of many lines laid end to end.

    ``ends`` holds the n + 1 line borders.  All open pieces of all lines split at once, so a
    round costs a few array passes however short the lines are.  The line ends are infinite;
    of equally far vertices the first one splits.
    """
    sig = np.zeros(len(x))
    first, last = ends[:-1].astype(np.int64), ends[1:].astype(np.int64) - 1
    filled = last >= first
    sig[first[filled]] = sig[last[filled]] = np.inf
    wide = last - first > 1
    a, b = first[wide], last[wide]
    cap = np.full(len(a), np.inf)
    while len(a):
        sizes = b - a - 1
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        piece = np.repeat(np.arange(len(a)), sizes)
        at = np.arange(len(piece)) - begins[piece] + a[piece] + 1
        dx, dy = x[b] - x[a], y[b] - y[a]
        length2 = dx * dx + dy * dy
        px, py = x[at] - x[a][piece], y[at] - y[a][piece]
        along = (px * dx[piece] + py * dy[piece]) / np.where(length2 > 0, length2, 1.0)[piece]
        t = np.where((length2 > 0)[piece], np.clip(along, 0.0, 1.0), 0.0)
        # As ``point_segment_distance``, operation by operation, so that equal distances are equal in both.
        off_x, off_y = x[at] - (x[a][piece] + dx[piece] * t), y[at] - (y[a][piece] + dy[piece] * t)
        d = np.sqrt(off_x * off_x + off_y * off_y)
        most = np.maximum.reduceat(d, begins)
        hits = np.flatnonzero(d == most[piece])
        far = at[hits[np.unique(piece[hits], return_index=True)[1]]]
        reach = np.minimum(cap, most)
        split = reach > 0
        sig[far[split]] = reach[split]
        a, b = (
            np.concatenate([a[split], far[split]]),
            np.concatenate([far[split], b[split]]),
        )
        cap = np.concatenate([reach[split], reach[split]])
        wide = b - a > 1
        a, b, cap = a[wide], b[wide], cap[wide]
    return sig


def vertex_runs(ends: np.ndarray, vertices: int) -> list[tuple[int, int]]:
    """Ranges of lines of at most that many vertices together, or of one longer line."""
    runs, start = [], 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + vertices, side="right")) - 1)
        runs.append((start, stop))
        start = stop
    return runs


@F.arrow_udf(SIG)
def _significance(xs: pa.Array, ys: pa.Array) -> pa.Array:
    ends = xs.offsets.to_numpy()
    begin, stop = ends[0], ends[-1]
    x = xs.values.to_numpy(zero_copy_only=False)[begin:stop]
    y = ys.values.to_numpy(zero_copy_only=False)[ys.offsets[0].as_py() : ys.offsets[-1].as_py()]
    ends = ends - begin
    sig = np.empty(len(x))
    for a, b in vertex_runs(ends, RUN_VERTICES):  # a round takes a dozen arrays as long as its lines
        u, v = ends[a], ends[b]
        sig[u:v] = batch_significance(x[u:v], y[u:v], ends[a : b + 1] - u)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sig))


def significance_m(geometry) -> Column:
    """Per-vertex significance in projected metres."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return _significance(
        F.transform(g, lambda p: mercator_x(p[0])), F.transform(g, lambda p: mercator_y(p[1]))
    )


def significance_deg(geometry) -> Column:
    """Per-vertex significance in degrees."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return _significance(F.transform(g, lambda p: p[0]), F.transform(g, lambda p: p[1]))


def keep_above(geometry: Column, sig: Column, threshold: Column) -> Column:
    """Vertices whose significance exceeds the threshold.

    The threshold is bound once a line; inside the filter it would be computed for every vertex.
    """
    line = F.array(F.struct(sig.alias("sig"), threshold.alias("least")))

    def kept(z: Column) -> Column:
        return F.filter(geometry, lambda p, i: F.get(z["sig"], i) > z["least"])

    return F.get(F.transform(line, kept), F.lit(0))


def at_tolerance(geometry: Column, sig_m: Column, tolerance_m: float | None) -> Column:
    if tolerance_m is None or tolerance_m <= 0:
        return geometry
    return keep_above(geometry, sig_m, F.lit(float(tolerance_m)))


def level_geometry(geometry: Column, sig_m: Column, lod: int) -> Column:
    return at_tolerance(geometry, sig_m, LOD_TOLERANCES_M[lod])


def target_threshold(dropped_from: Column, extent: Column) -> Column:
    """Smallest multiple of extent / 2^20 that drops significance ``dropped_from``.

    -1 (keep all) when there is nothing to drop or no tested tolerance is enough.
    """
    step = extent / float(2**BISECTION_STEPS)
    k = F.greatest(F.lit(1.0), F.ceil(dropped_from / F.when(step > 0, step)).cast("double"))
    return (
        F.when(dropped_from.isNull(), -1.0)
        .when(step <= 0, 0.0)
        .when(k >= 2**BISECTION_STEPS, -1.0)  # no tolerance below the extent is enough
        .otherwise(k * step)
    )


def at_target(geometry: Column, sig_deg: Column, extent: Column, target: int) -> Column:
    """At most ``target`` vertices, at the smallest bisected tolerance that allows it."""
    ranked = F.sort_array(sig_deg, asc=False)
    threshold = target_threshold(F.get(ranked, F.lit(target)), extent)
    return F.when(F.size(geometry) <= target, geometry).otherwise(
        keep_above(geometry, sig_deg, threshold)
    )


def line_extent(geometry: Column) -> Column:
    """Larger side of the line's bounding box."""
    xs, ys = F.transform(geometry, lambda p: p[0]), F.transform(geometry, lambda p: p[1])
    return F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def simplify_m(geometry, tolerance_m: float | None) -> Column:
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return at_tolerance(g, significance_m(g), tolerance_m)


def simplify_to_target(rows: DataFrame, geometry: str, target: int, name: str) -> DataFrame:
    """Add the line of at most ``target`` vertices of rows that hold whole lines."""
    return simplify_to_targets(rows, geometry, {name: target})


def simplify_to_targets(rows: DataFrame, geometry: str, targets: dict[str, int]) -> DataFrame:
    """``simplify_to_target`` for several columns and their targets; a line is measured once."""
    line = F.col(geometry)
    lines = {name: at_target(line, F.col("_sig"), line_extent(line), target) for name, target in targets.items()}
    return rows.withColumn("_sig", significance_deg(line)).withColumns(lines).drop("_sig")


PIECE_POINTS = CHUNK_POINTS


def piece_significance(table: pa.Table) -> pa.Table:
    """Significance above the floor of one open piece, all of whose points are at hand."""
    table = table.sort_by("seq")
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    x, y = ([a[c], *table[c].to_pylist(), b[c]] for c in ("x", "y"))
    whole = batch_significance(np.array(x), np.array(y), np.array([0, len(x)]))
    sig = np.minimum(whole[1:-1], table["cap"][0].as_py())
    keep = pa.array(sig > table["floor"].to_numpy())
    out = pa.table([table["activity_id"], table["seq"], pa.array(sig)], names=["activity_id", "seq", "significance"])
    return out.filter(keep)


def long_significance(
    vertices: DataFrame, floor: Column | float = 0.0, piece_points: int = PIECE_POINTS
) -> DataFrame:
    """Significance above ``floor`` for lines too long for one task.

    ``vertices`` is (activity_id, seq, x, y) and may carry the columns ``floor`` uses.  Each
    round finds the farthest vertex of every open piece with a partial ``max`` and splits the
    piece there, until pieces have at most ``piece_points`` points; those are finished one to a
    group.  So a line of n such pieces takes a few rounds more than the depth down to them.  The
    layout is checkpointed once per round, so a lost executor repeats one round.
    """
    c = F.col
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    at = F.struct("seq", "x", "y")
    piece = ["activity_id", "a_seq"]
    ends = vertices.groupBy("activity_id").agg(
        F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b")
    )
    opened = vertices.withColumn("floor", floor).join(ends, "activity_id").select(
        "activity_id", "seq", "x", "y", "floor", "a", "b", F.lit(float("inf")).alias("cap"), c("a.seq").alias("a_seq")
    )
    done = [
        ends.select("activity_id", F.explode(F.array("a.seq", "b.seq")).alias("seq"))
        .distinct()
        .withColumn("significance", F.lit(float("inf")))
    ]
    opened = cut_lineage(opened.where("seq > a.seq AND seq < b.seq"))
    kind = vertices.schema["activity_id"].dataType.simpleString()
    while True:
        reach = point_segment_distance(c("x"), c("y"), c("a.x"), c("a.y"), c("b.x"), c("b.y"))
        farthest = F.max(F.struct(reach.alias("d"), (-c("seq")).alias("back"), at.alias("m")))
        pieces = cut_lineage(
            opened.groupBy(*piece, "cap", "floor")
            .agg(farthest.alias("f"), F.count(F.lit(1)).alias("n"))
            .select(*piece, "n", c("f.m").alias("m"), F.least("cap", "f.d").alias("reach"), "floor")
            .where("reach > floor")
            .drop("floor")
        )
        short = opened.join(pieces.where(c("n") <= piece_points).select(*piece), piece, "left_semi")
        done.append(
            short.groupBy(*piece).applyInArrow(piece_significance, f"activity_id {kind}, seq long, significance double")
        )
        splits = pieces.where(c("n") > piece_points).drop("n")
        if splits.isEmpty():
            break
        done.append(splits.select("activity_id", c("m.seq").alias("seq"), c("reach").alias("significance")))
        before = c("seq") < c("m.seq")
        opened = opened.join(splits, piece).where("seq <> m.seq").select(
            "activity_id",
            "seq",
            "x",
            "y",
            "floor",
            F.when(before, c("a")).otherwise(c("m")).alias("a"),
            F.when(before, c("m")).otherwise(c("b")).alias("b"),
            c("reach").alias("cap"),
            F.when(before, c("a_seq")).otherwise(c("m.seq")).alias("a_seq"),
        )
        opened = cut_lineage(opened)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _aligned(vertices: DataFrame, sig: DataFrame, name: str) -> DataFrame:
    """Significance arrays in part order for multi-part tracks."""
    return (
        vertices.select("activity_id", "seq", "part")
        .join(sig, ["activity_id", "seq"], "left")
        .groupBy("activity_id", "part")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("seq", F.coalesce("significance", F.lit(0.0)).alias("s")))
            ).alias("_s")
        )
        .select("activity_id", "part", F.transform("_s", lambda z: z["s"]).alias(name))
    )


LINES = (("geometry", "r_"), ("geometry_clean", "c_"))


def with_significance(parts: DataFrame, lines=LINES) -> DataFrame:
    """Add ``{prefix}sig_m`` and ``{prefix}sig_deg`` arrays to rows that hold whole lines."""
    return parts.withColumns(
        {
            f"{prefix}{name}": fn(F.col(line))
            for line, prefix in lines
            for name, fn in (("sig_m", significance_m), ("sig_deg", significance_deg))
        }
    )


def split_long(
    parts: DataFrame, several: bool | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of one-part tracks, checkpointed rows of longer tracks or None).

    ``several`` says whether there are longer tracks; it is looked up when not given.
    """
    ids = parts.where("part > 0").select("activity_id").distinct()
    if several is None:
        several = not ids.isEmpty()
    if not several:
        return parts, None
    ids = cut_lineage(ids)
    return (
        parts.join(ids, "activity_id", "left_anti"),
        cut_lineage(parts.join(ids, "activity_id", "left_semi")),
    )


def with_long_significance(
    wide: DataFrame, chunk_points: int = CHUNK_POINTS, lines=LINES
) -> DataFrame:
    """``with_significance`` for tracks of several parts; ``wide`` is checkpointed."""
    key = ["activity_id", "part"]
    lowest = min(t for t in LOD_TOLERANCES_M if t)
    none = F.array().cast(SIG)
    out = wide
    for line, prefix in lines:
        vertices = wide.select(
            "activity_id", "part", F.posexplode(line).alias("at", "p")
        ).select(
            "activity_id",
            "part",
            (F.col("part") * chunk_points + F.col("at")).alias("seq"),
            F.col("p")[0].alias("lon"),
            F.col("p")[1].alias("lat"),
        )
        metres = vertices.select(
            "activity_id", "seq", mercator_x("lon").alias("x"), mercator_y("lat").alias("y")
        )
        extent = vertices.groupBy("activity_id").agg(
            F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("_extent")
        )
        degrees = vertices.join(extent, "activity_id").select(
            "activity_id", "seq", F.col("lon").alias("x"), F.col("lat").alias("y"), "_extent"
        )
        finest = F.col("_extent") / float(2**BISECTION_STEPS)
        for name, sig in (
            (f"{prefix}sig_m", long_significance(metres, lowest)),
            (f"{prefix}sig_deg", long_significance(degrees, finest)),
        ):
            aligned = cut_lineage(_aligned(vertices, sig, name))
            out = out.join(aligned, key, "left").withColumn(name, F.coalesce(name, none))
    return cut_lineage(out)


def target_thresholds(parts: DataFrame, geometry: str, sig_deg: str, targets) -> DataFrame:
    """Per track of several parts: the threshold that meets each vertex target (``t<target>``).

    Only the best ``max(targets) + 1`` values of a part, and then of a track, matter.
    """
    xs = F.transform(F.col(geometry), lambda p: p[0])
    ys = F.transform(F.col(geometry), lambda p: p[1])
    most = max(targets) + 1
    best = F.slice(F.sort_array(sig_deg, asc=False), 1, most)
    values = parts.select("activity_id", "part", F.posexplode(best).alias("_at", "_s"))
    ranked = (
        top_per_key(values, ["activity_id"], [F.desc("_s")], most, "_rn")
        .groupBy("activity_id")
        .agg(*[F.max(F.when(F.col("_rn") == t + 1, F.col("_s"))).alias(f"_s{t}") for t in targets])
    )
    extent = parts.select(
        "activity_id",
        F.array_min(xs).alias("_x0"),
        F.array_max(xs).alias("_x1"),
        F.array_min(ys).alias("_y0"),
        F.array_max(ys).alias("_y1"),
    ).groupBy("activity_id").agg(
        F.greatest(F.max("_x1") - F.min("_x0"), F.max("_y1") - F.min("_y0")).alias("_extent")
    )
    return ranked.join(extent, "activity_id").select(
        "activity_id",
        *[
            F.coalesce(target_threshold(F.col(f"_s{t}"), F.col("_extent")), F.lit(-1.0)).alias(f"t{t}")
            for t in targets
        ],
    )

"""Query session over one compiled dataset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import MAX_LOD, requested_lod, scheduled_vertex_budget
from ..functions.predicates import Bounds
from ..operators import dimensions as dim
from ..operators import selection as sel
from ..operators import spatial as sp
from ..operators import tracks as tr
from ..operators.activities import clean_view
from ..schema import CLEAN_VERSIONS
from ..session import use_utc
from ..sources.dataset import scan_canonical, scan_metadata, scan_render
from . import render as rn
from .writers import read_manifest


# The metadata index is kept resident up to this many activities; beyond it, scans with


@dataclass(frozen=True)
class SelectionSpec:
    """A selection: SQL over ``activities``, clean values or not, and an optional polygon."""

    sql: str = "SELECT activity_id FROM activities"
    clean: bool = False
    polygon: list[tuple[float, float]] | None = None
    predicate: str = "intersects"


@dataclass
class DatasetSession:
    """Selections and reads of a dataset.

    SQL runs in an isolated session that knows the temporary views ``activities`` and
    ``activities_full`` only, cannot open files by path, and accepts queries, not commands.
    """

    parent: SparkSession
    root: str
    selected: DataFrame | None = None
    dimensions: DataFrame | None = None
    clean: bool = False
    _kept: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark = use_utc(self.parent.newSession())
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.manifest = read_manifest(self.spark, self.root)
        # A published root names the folder of its active build.
        self.root = f"{self.root.rstrip('/')}/{self.manifest.get('build_path', '')}".rstrip("/")
        self.metadata = scan_metadata(self.spark, self.root)
        self.metadata = self.metadata.persist(StorageLevel.MEMORY_AND_DISK)
        self.canonical = scan_canonical(self.spark, self.root)
        self._use_view(False)

    @property
    def supports_clean(self) -> bool:
        return self.manifest.get("schema_version") in CLEAN_VERSIONS

    def _use_view(self, clean: bool) -> None:
        if clean and not self.supports_clean:
            raise ValueError("clean values need dataset schema 1.2.0 or newer")
        self.clean = clean
        self.activities = clean_view(self.metadata) if clean else self.metadata
        self.activities.createOrReplaceTempView("activities")
        full = clean_view(self.canonical) if clean else self.canonical
        full.createOrReplaceTempView("activities_full")

    def execute(self, spec: SelectionSpec) -> DataFrame | None:
        """Make a selection current; None when it selects everything."""
        self._use_view(spec.clean)
        for df in self._kept:
            df.unpersist()
        self._kept, self.selected, self.dimensions = [], None, None
        universal = sel.is_universal(sel.normalize_sql(spec.sql))
        chosen = None if universal else sel.dedupe_selection(sel.select(self.spark, spec.sql))
        if spec.polygon:
            lines = self.canonical.select(
                "activity_id",
                "part",
                F.col("geometry_clean" if spec.clean else "geometry").alias("geometry"),
            )
            scope = sel.semi(self.activities, chosen)
            edges = self._edges(lines)
            chosen = sp.polygon_filter(scope, edges, spec.polygon, spec.predicate)
        if chosen is None:
            return None
        chosen = chosen.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(chosen)
        self.selected = chosen
        if sel.dimension_columns(chosen):
            self.dimensions = dim.dimension_values(chosen)
        return chosen

    def _edges(self, lines: DataFrame) -> DataFrame:
        """Edges inside stored parts, and the ones that join each part to the one before with vertices."""
        g = F.col("geometry")
        ends = lines.where(F.size(g) > 0).select(
            "activity_id", "part", F.get(g, F.lit(0)).alias("n"), F.get(g, F.size(g) - 1).alias("_last")
        )
        track = Window.partitionBy("activity_id").orderBy("part")  # one light row a part
        bridges = ends.withColumn("b", F.lag("_last").over(track)).where("b IS NOT NULL").select(
            "activity_id",
            (F.col("part") * (1 << 24) - 1).alias("seq"),
            F.col("b")[0].alias("x0"),
            F.col("b")[1].alias("y0"),
            F.col("n")[0].alias("x1"),
            F.col("n")[1].alias("y1"),
        )
        return rn.line_edges(lines).unionByName(bridges)

    def count(self) -> int:
        if self.selected is None:
            return int(self.manifest["activity_count"])
        return sel.semi(self.metadata, self.selected).count()

    def summary(self, bounds: Bounds | None = None) -> DataFrame:
        return sel.summary(self.metadata, self.selected, bounds, self.clean)

    def family_counts(self, bounds: Bounds | None = None) -> DataFrame:
        return sel.family_counts(self.metadata, self.selected, bounds, self.clean)

    def table(self, bounds: Bounds | None = None) -> DataFrame:
        return sel.activity_table(self.metadata, self.selected, bounds, self.clean)

    def route_metadata(self, activity_id: str) -> DataFrame:
        return sel.route_metadata(self.metadata, activity_id, self.clean)

    def _shard(self, activity_id: str) -> DataFrame | None:
        """All rows of one activity.

        The shards are sorted by family, spatial order and id, so the partition and the pushed
        order leave a row group or two to read, however many parts the track has.
        """
        found = (
            self.metadata.where(F.col("activity_id") == activity_id)
            .select("activity_family", "spatial_order")
            .take(1)
        )
        if not found:
            return None
        return self.canonical.where(
            (F.col("activity_family") == found[0].activity_family)
            & F.col("spatial_order").eqNullSafe(found[0].spatial_order)
            & (F.col("activity_id") == activity_id)
        )

    def activity_detail(self, activity_id: str) -> DataFrame | None:
        """Scalars and lines of one activity (a row per part)."""
        rows = self._shard(activity_id)
        if rows is None:
            return None
        c = self.clean
        return rows.select(
            "activity_id",
            "part",
            "name",
            "sport_type",
            "start_time",
            sel.clean_or_raw("distance_m", c).alias("distance_m"),
            sel.clean_or_raw("elevation_gain_m", c).alias("elevation_gain_m"),
            sel.clean_or_raw("max_elevation_m", c).alias("max_elevation_m"),
            "source_url",
            F.col("geometry_clean" if c else "geometry").alias("path"),
        )

    def elevation_profile(self, activity_id: str) -> DataFrame | None:
        rows = self._shard(activity_id)
        if rows is None:
            return None
        points = tr.points_from_parts(rows)
        if self.clean:
            legs = tr.with_legs(points)
            points = tr.clean_points(
                legs.withColumns({"dropped_jump": F.lit(False), "dropped_elevation": F.lit(False)})
            )
        return tr.elevation_profile(points)

    def render(
        self,
        zoom: float,
        bounds: Bounds | None = None,
        visible: Bounds | None = None,
        resolution: str = "medium",
        three_d: bool = False,
        budget: int | None = None,
        fill: bool = False,
        pixel_error: float = 1.0,
        bias: int = 0,
        start: int | None = None,
    ) -> rn.Viewport:
        wanted = self.spark.range(1).select(
            requested_lod(float(zoom), pixel_error, bias).alias("lod"),
            scheduled_vertex_budget(float(zoom), resolution, three_d).alias("budget"),
        ).first()
        levels = scan_render(self.spark, self.root, None, bounds, self.clean)
        return rn.render_viewport(
            levels,
            self.metadata,
            min(MAX_LOD, wanted.lod),
            budget if budget is not None else wanted.budget,
            self.selected,
            bounds,
            visible,
            self.clean,
            fill,
            start,
            three_d,
        )

    def close(self) -> None:
        for df in [*self._kept, self.metadata]:
            df.unpersist()

"""Index tables over cells: regions, edges, chips, blocks and tiles, each built once and kept.

A table is written to the shared scratch folder when first asked for, and reused by every later
query of the session on the same source and parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import distance, grid
from ..operators.components import grid_components
from ..operators.graph import staged
from ..operators.rank import number_rows
from ..sources import cells as src
from ..sources import rasters
from ..sources.store import IndexStore, fingerprint_of

#: Components of fewer cells are no region.  Cells a side of a chip and of a tile; quadtree depth.
MIN_AREA_PX, CHIP, TILE = 12, 16, 40


class Index:
    """Index tables of one map: of the grid derived from the tables in sf_dir, or of cells given.

    Cells have r, c, class_id and valid; class_id2, valid2 and elev may be missing and are null then.
    stride is the multiplier that makes (r, c) one number: more than the largest c.  With a store,
    the dear tables are kept across sessions, under a fingerprint of the cells and the parameters.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, cells: DataFrame | None = None, gsd: float = src.GSD, stride: int = src.STRIDE, store: IndexStore | None = None):
        self.spark, self.sf_dir, self.given, self.gsd, self.stride, self.store = spark, sf_dir, cells, gsd, stride, store
        self.pixel_m2 = gsd * gsd
        self.has_terrain = cells is None or "elev" in cells.columns

    @classmethod
    def from_raster(cls, spark: SparkSession, path: str, gsd: float, mapping=None, store: IndexStore | None = None) -> Index:
        """Of a label raster, or of a directory of tiles, which are put together by their placement."""
        tiles = rasters.files(spark, path).select("path").limit(2).count()
        cells = rasters.mosaic(spark, path, mapping) if tiles > 1 else rasters.labels(spark, path, mapping).drop("path")
        cells = staged(cells)
        wide = cells.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
        return cls(spark, cells=cells, gsd=gsd, stride=wide + 1, store=store)

    def _kept(self, kind: str, build: Callable[[], DataFrame], **params) -> DataFrame:
        if self.store is None:
            return staged(build())
        return self.store.get(kind, self.fingerprint, {"gsd": self.gsd, "stride": self.stride, **params}, build)

    @cached_property
    def fingerprint(self) -> str:
        return fingerprint_of(self.cells)

    @cached_property
    def cells(self) -> DataFrame:
        if self.given is None:
            return staged(src.derived_cells(self.spark, self.sf_dir))
        more = {"class_id2": "int", "valid2": "boolean", "elev": "double"}
        return staged(self.given.select("r", "c", F.col("class_id").cast("int").alias("class_id"), "valid", *(F.col(n) if n in self.given.columns else F.lit(None).cast(t).alias(n) for n, t in more.items())))

    @cached_property
    def dim(self) -> DataFrame:
        return F.broadcast(tx.dim_class(self.spark))

    @cached_property
    def pairs(self) -> DataFrame:
        return F.broadcast(tx.dim_class_pair(self.spark))

    @cached_property
    def valid(self) -> DataFrame:
        return self.cells.where("valid")

    @cached_property
    def slope(self) -> DataFrame:
        """Cells with gx, gy and slope in degrees."""
        return grid.gradient(self.cells, self.gsd).withColumn("slope", grid.slope_degrees())

    @cached_property
    def components(self) -> DataFrame:
        """(r, c, key, root) of all valid cells, keyed by class."""
        return self._kept("components", lambda: grid_components(self.cells.withColumn("key", F.when(F.col("valid"), F.col("class_id"))), "key", self.stride))

    @cached_property
    def region_ids(self) -> DataFrame:
        sizes = self.components.groupBy("root", F.col("key").cast("int").alias("class_id")).agg(F.count("*").alias("area_px")).where(F.col("area_px") >= MIN_AREA_PX)
        return self._kept("region_ids", lambda: number_rows(sizes, ["class_id", "root"], "region_id"), least=MIN_AREA_PX)

    @cached_property
    def cell_region(self) -> DataFrame:
        return staged(self.components.join(self.region_ids.select("root", "region_id", "class_id"), "root").select("r", "c", "region_id", "class_id"))

    @cached_property
    def perimeters(self) -> DataFrame:
        """(root, perim_px): edges to another component or to nothing, below and to the right, and mirrored.

        Cells above the first row and left of the first column aren't looked at, so those borders
        don't count: the numbers stay comparable with earlier ones.
        """
        full = self.cells.select("r", "c").join(self.components.select("r", "c", "root"), ["r", "c"], "left")
        out = []
        for a, b in (("r", "c"), ("c", "r")):
            w = Window.partitionBy(a).orderBy(b)
            nxt = F.lead("root").over(w)
            both = full.select("root", nxt.alias("other")).where(~F.col("root").eqNullSafe(F.col("other")))
            out += [both.select("root"), both.select(F.col("other").alias("root"))]
        return reduce(DataFrame.unionByName, out).where("root is not null").groupBy("root").agg(F.count("*").alias("perim_px"))

    @cached_property
    def regions(self) -> DataFrame:
        cr = self.cell_region.join(self.slope.select("r", "c", "slope", "gx", "gy", "elev"), ["r", "c"])
        theta = F.atan2(F.col("gy"), -F.col("gx"))
        zonal = cr.groupBy("region_id").agg(
            F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"),
            F.avg("r").alias("cy"), F.avg("c").alias("cx"), F.avg("slope").alias("mean_slope"),
            F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("slope") * F.col("slope")) - F.avg("slope") * F.avg("slope"))).alias("std_slope"),
            F.avg("elev").alias("mean_elev"),
            (1 - F.hypot(F.avg(F.cos(theta)), F.avg(F.sin(theta)))).alias("aspect_circvar"),
        )
        out = self.region_ids.join(self.perimeters, "root").join(zonal, "region_id")
        p, high, wide = F.col("perim_px") * self.gsd, F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
        area = F.col("area_px") * self.pixel_m2
        out = out.withColumn("area_m2", area).withColumn("perimeter_m", p).withColumn("compactness", F.when(p > 0, 4 * F.pi() * area / (p * p)).otherwise(0.0))
        return self._kept("regions", lambda: out.withColumn("elongation", F.greatest(high, wide) / F.greatest(F.lit(1), F.least(high, wide))), least=MIN_AREA_PX)

    @cached_property
    def edges(self) -> DataFrame:
        """(a, b, shared_px) of touching regions, a < b: pre-aggregated, never a neighbour list."""
        marked = self.cell_region.withColumn("valid", F.lit(True))
        pairs = grid.neighbour_pairs(marked, "region_id").where("a <> b")
        return self._kept("edges", lambda: pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared_px")), least=MIN_AREA_PX)

    @cached_property
    def neighbour_hist(self) -> DataFrame:
        """(region_id, class_id, nbr_class, shared_px, share): boundary with each neighbouring class."""
        both = self.edges.unionByName(self.edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared_px"))
        own = self.region_ids.select(F.col("region_id").alias("a"), "class_id")
        other = self.region_ids.select(F.col("region_id").alias("b"), F.col("class_id").alias("nbr_class"))
        hist = both.join(own, "a").join(other, "b").groupBy(F.col("a").alias("region_id"), "class_id", "nbr_class").agg(F.sum("shared_px").alias("shared_px"))
        total = F.sum("shared_px").over(Window.partitionBy("region_id"))
        return staged(hist.withColumn("share", F.col("shared_px") / total))

    @cached_property
    def chip_class(self) -> DataFrame:
        """(chip_r, chip_c, class_id, px) over valid cells of whole chips; the ragged margin is left out."""
        end = self.cells.agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
        inside = (F.col("r") < F.floor((F.col("mr") + 1) / CHIP) * CHIP) & (F.col("c") < F.floor((F.col("mc") + 1) / CHIP) * CHIP)
        whole = self.valid.join(F.broadcast(end)).where(inside)
        return staged(whole.groupBy(F.floor(F.col("r") / CHIP).alias("chip_r"), F.floor(F.col("c") / CHIP).alias("chip_c"), "class_id").agg(F.count("*").alias("px")))

    @cached_property
    def chips(self) -> DataFrame:
        n = F.sum("px").over(Window.partitionBy("chip_r", "chip_c"))
        frac = self.chip_class.withColumn("n_px", n).withColumn("frac", F.col("px") / n)
        return staged(frac.groupBy("chip_r", "chip_c", "n_px").agg((-F.sum(F.col("frac") * F.log2("frac"))).alias("entropy"), F.count("*").alias("n_classes")))

    @cached_property
    def chip_frac(self) -> DataFrame:
        return self.chip_class.join(self.chips.select("chip_r", "chip_c", "n_px"), ["chip_r", "chip_c"]).withColumn("frac", F.col("px") / F.col("n_px"))

    @cached_property
    def anchor_d2(self) -> DataFrame:
        """(r, c, anchor, d2) for every anchor class: one seed a group, so one pass for all."""
        seeds = F.explode(F.array(*(F.lit(k) for k in tx.ids(tx.ANCHORS)))).alias("anchor")
        each = self.cells.select("r", "c", "class_id", "valid", seeds)
        return self._kept("anchor_d2", lambda: distance.nearest_d2(each.withColumn("seed", F.col("valid") & (F.col("class_id") == F.col("anchor"))), "seed", "anchor"))

    @cached_property
    def chip_anchor(self) -> DataFrame:
        """(chip_r, chip_c, anchor, d2): the least distance of any cell of the chip; null if the class is absent."""
        at = self.anchor_d2.groupBy(F.floor(F.col("r") / CHIP).alias("chip_r"), F.floor(F.col("c") / CHIP).alias("chip_c"), "anchor").agg(F.min("d2").alias("d2"))
        return staged(at.join(self.chips.select("chip_r", "chip_c"), ["chip_r", "chip_c"], "left_semi"))

    @cached_property
    def ways(self) -> DataFrame:
        if self.sf_dir is None:
            return self.spark.createDataFrame([], "way_id long, horiz boolean, pos long, half long")
        return staged(src.derived_ways(self.spark, self.sf_dir, self.cells))

    @cached_property
    def way_cells(self) -> DataFrame:
        """Cells of each way: its run of rows or columns is exploded, so cells are met by equality."""
        lines = self.ways.select("way_id", "horiz", F.explode(F.sequence(F.col("pos") - F.col("half"), F.col("pos") + F.col("half"))).alias("line"))
        at = lambda axis, flag: self.cells.select("r", "c").join(F.broadcast(lines.where(F.col("horiz") == flag).select("way_id", F.col("line").alias(axis))), axis)
        return staged(at("r", True).select("way_id", "r", "c").unionByName(at("c", False).select("way_id", "r", "c")))

    @cached_property
    def road_cells(self) -> DataFrame:
        return self.way_cells.select("r", "c").distinct()

    @cached_property
    def blocks(self) -> DataFrame:
        """(r, c, root) of valid cells off the roads, by 8-connected piece."""
        free = self.valid.join(self.road_cells, ["r", "c"], "left_anti").withColumn("key", F.lit(1))
        return staged(grid_components(free, "key", self.stride).select("r", "c", "root"))


_INDEXES: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Index(spark, sf_dir)
    return _INDEXES[key]

"""Two dates: transitions and their meaning, change components, tile summaries and their difference."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators.components import grid_components
from ..operators.graph import staged
from .index import TILE

# Smallest event; shift, credit, look and structural thresholds of tile verdicts.
MIN_EVENT_M2, MIN_SHIFT, CREDIT, LOOK, STRUCTURAL = 20.0, 0.08, 1.0, 0.12, 0.05
TOP_CLASSES = 4


#: Classes there are: the stride of a pair's key.
N_CLASSES = 47


def pair_key(a: Column, b: Column) -> Column:
    """Two class ids as one number."""
    return a * N_CLASSES + b


def pair_of(key: Column) -> tuple[Column, Column]:
    return F.floor(key / N_CLASSES).cast("int"), (key % N_CLASSES).cast("int")


def grids_match(a: dict, b: dict) -> str:
    """Why two tile grids (tile_px, cols, rows, shape) can't be compared; empty if they can."""
    other = [k for k in ("tile_px", "cols", "rows", "shape") if a.get(k) != b.get(k)]
    return f"the grids have another {other[0]}: {a.get(other[0])} and {b.get(other[0])}" if other else ""


class Change:
    def __init__(self, i):
        self.i = i

    @cached_property
    def joined(self) -> DataFrame:
        """Both dates' valid cells met by position: a full outer join, so one-sided coverage shows."""
        a = self.i.cells.where("valid").select("r", "c", F.col("class_id").alias("a"))
        b = self.i.cells.where("valid2").select("r", "c", F.col("class_id2").alias("b"))
        return a.join(b, ["r", "c"], "full_outer")

    def pairs(self) -> DataFrame:
        """(a, b, px, category) of co-valid changed cells."""
        px = self.joined.where("a is not null and b is not null and a <> b").groupBy("a", "b").agg(F.count("*").alias("px"))
        return px.join(self.i.pairs.select("a", "b", "category"), ["a", "b"])

    def events(self) -> DataFrame:
        return self.pairs().withColumn("area_m2", F.col("px") * self.i.pixel_m2).where(F.col("area_m2") >= MIN_EVENT_M2)

    def summary(self) -> DataFrame:
        """Changed share counts every changed cell; coverage is what one date alone has seen."""
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        return self.joined.agg(F.count_if(both).alias("covalid"), F.count_if(both & (F.col("a") != F.col("b"))).alias("changed"), F.count_if(~both).alias("one_sided"), F.count("*").alias("seen"))

    @cached_property
    def components(self) -> DataFrame:
        """(a, b, components): 8-connected pieces of each transition, labelled all at once by its key."""
        keyed = self.joined.where("a is not null and b is not null and a <> b").withColumn("key", pair_key(F.col("a"), F.col("b")))
        a, b = pair_of(F.col("key"))
        return staged(grid_components(keyed, "key", self.i.stride)).groupBy(a.alias("a"), b.alias("b")).agg(F.count_distinct("root").alias("components"))


def tile_classes(cells: DataFrame, value: str, valid: str) -> DataFrame:
    """(tile_r, tile_c, class_id, px, n, frac, k) of each tile; a ragged margin is kept."""
    w = Window.partitionBy("tile_r", "tile_c")
    h = cells.where(valid).groupBy(F.floor(F.col("r") / TILE).alias("tile_r"), F.floor(F.col("c") / TILE).alias("tile_c"), F.col(value).alias("class_id")).agg(F.count("*").alias("px"))
    h = h.withColumn("n", F.sum("px").over(w)).withColumn("frac", F.col("px") / F.col("n"))
    return h.withColumn("k", F.row_number().over(w.orderBy(F.desc("px"), "class_id")))


def tile_rollup(i, value: str = "class_id", valid: str = "valid") -> DataFrame:
    """(tile_r, tile_c, classes map of the top four, rest, volatility): what a summary of a tile holds."""
    t = tile_classes(i.cells, value, valid).join(i.dim.select("class_id", "volatility"), "class_id")
    top = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k") <= TOP_CLASSES, F.struct("class_id", "frac")))))
    return t.groupBy("tile_r", "tile_c").agg(top.alias("classes"), F.sum(F.when(F.col("k") > TOP_CLASSES, F.col("frac")).otherwise(0.0)).alias("rest"), F.sum(F.col("frac") * F.col("volatility")).alias("volatility"))


def tile_diff(i) -> DataFrame:
    """Tiles of two dates compared by their summaries, and a verdict.

    A class that only one summary lists may still be in the other's rest, so it counts for no more
    than it exceeds that rest: shift is a lower bound.  Volatility of either date forgives change.
    """
    a, b = tile_rollup(i), tile_rollup(i, "class_id2", "valid2")
    rows = []
    for t, side in ((a, "a"), (b, "b")):
        rows.append(t.select("tile_r", "tile_c", F.explode("classes").alias("class_id", side)))
    meta = a.select("tile_r", "tile_c", F.col("rest").alias("ra"), F.col("volatility").alias("va")).join(b.select("tile_r", "tile_c", F.col("rest").alias("rb"), F.col("volatility").alias("vb")), ["tile_r", "tile_c"])
    both = rows[0].join(rows[1], ["tile_r", "tile_c", "class_id"], "full_outer").join(meta, ["tile_r", "tile_c"])
    part = F.when(F.col("a").isNull(), F.greatest(F.lit(0.0), F.col("b") - F.col("ra"))).when(F.col("b").isNull(), F.greatest(F.lit(0.0), F.col("a") - F.col("rb"))).otherwise(F.abs(F.col("a") - F.col("b")))
    move = F.when(F.col("class_id").isin(tx.ids(tx.BUILT)), F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).otherwise(0.0)
    out = both.groupBy("tile_r", "tile_c", "va", "vb").agg((0.5 * F.sum(part)).alias("shift"), F.greatest(F.sum(F.greatest(F.lit(0.0), move)), F.sum(F.greatest(F.lit(0.0), -move))).alias("structural"))
    excess = F.col("shift") * F.greatest(1 - CREDIT * 0.5 * (F.col("va") + F.col("vb")), F.lit(0.0))
    r = lambda c: F.round(c, 9)
    verdict = F.when(r(F.col("structural")) >= STRUCTURAL, "structural").when(r(F.col("shift")) < MIN_SHIFT, "quiet").when(r(excess) >= LOOK, "worth-a-look").otherwise("expected")
    return out.select("tile_r", "tile_c", F.round("shift", 5).alias("shift"), F.round(excess, 5).alias("excess"), F.round("structural", 5).alias("structural"), verdict.alias("verdict"))


def tile_movers(i, most: int = 3) -> DataFrame:
    """(tile_r, tile_c, class_id, delta, k): the classes that gained most, by full histograms."""
    a = tile_classes(i.cells, "class_id", "valid").select("tile_r", "tile_c", "class_id", F.col("frac").alias("fa"))
    b = tile_classes(i.cells, "class_id2", "valid2").select("tile_r", "tile_c", "class_id", F.col("frac").alias("fb"))
    d = a.join(b, ["tile_r", "tile_c", "class_id"], "full_outer").withColumn("delta", F.round(F.coalesce("fb", F.lit(0.0)) - F.coalesce("fa", F.lit(0.0)), 6)).where("delta > 0")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("tile_r", "tile_c").orderBy(F.desc("delta"), "class_id"))).where(F.col("k") <= most)

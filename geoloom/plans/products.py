"""Per-cell products in [0, 1].  An unmeasured cell is null in a provider's result, never 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import grid

# Free slope, concealment of shadow, beside buildings and of relief, canopy clump and
# exponent cap, roughness window; fabric window, density weight, saturation and built threshold.
SLOPE_FREE = 5.0
SHADOW, BESIDE_BUILT, RELIEF = 0.6, 0.5, 0.25
CLUMP_M2, EXPONENT_CAP, ROUGHNESS_PX = 4.0, 6.0, 5
FABRIC_M, DENSITY, SATURATION, ANTHROPOGENIC = 50.0, 0.45, 0.6, 0.45


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def odd_window_px(metres: float, gsd: float) -> int:
    """The nearest odd number of cells, 3 at least."""
    k = int(metres / gsd)
    return max(3, k + 1 - k % 2)


#: What can be asked for by name, in the order of names; the provider's product comes last.
PRODUCTS = ("built_fabric", "change_volatility", "concealment", "trafficability")


def product_keys() -> tuple[str, ...]:
    return (*PRODUCTS, "traversability")


def target_cover(cells: DataFrame, mask: str, side: int, name: str) -> DataFrame:
    """cells with the share of a target's own footprint, an odd square about its side, that lies in a 0/1 mask."""
    return grid.box_mean(cells, mask, side + 1 - side % 2, name) if side > 1 else cells.withColumn(name, F.col(mask).cast("double"))


def trafficability(i, vehicle: str = "wheeled", wet: bool = False) -> DataFrame:
    """Surface times slope, 0 below the vehicle's least surface, less on wet ground."""
    if vehicle not in tx.VEHICLES:
        raise ValueError(f"unknown vehicle {vehicle!r}; there are {', '.join(sorted(tx.VEHICLES))}")
    top, least, loss, _ = tx.VEHICLES[vehicle]
    ground = i.slope.join(i.dim.select("class_id", "traffic"), "class_id")
    score = F.when(F.col("traffic") < least, 0.0).otherwise(F.col("traffic") * clip01(1 - (F.col("slope") - SLOPE_FREE) / max(top - SLOPE_FREE, 1e-6)))
    if wet:
        score = score * F.when(F.col("class_id").isin(tx.ids(tx.WET)), 1 - loss).otherwise(1.0)
    return ground.select("r", "c", "class_id", "valid", score.alias("score"))


def change_volatility(i) -> DataFrame:
    return i.cells.join(i.dim.select("class_id", "volatility"), "class_id").select("r", "c", "class_id", "valid", F.col("volatility").alias("score"))


def built_fabric(i) -> DataFrame:
    k = odd_window_px(FABRIC_M, i.gsd)
    ground = i.cells.join(i.dim.select("class_id", "fabric"), "class_id").withColumn("anthro", (F.col("fabric") >= ANTHROPOGENIC).cast("int"))
    score = (1 - DENSITY) * F.col("fabric") + DENSITY * clip01(F.col("near") / SATURATION)
    return grid.box_mean(ground, "anthro", k, "near").select("r", "c", "class_id", "valid", score.alias("score"))


def concealment(i, target: str = "person") -> DataFrame:
    """How well a target of a named size is hidden from above."""
    if target not in tx.TARGETS:
        raise ValueError(f"unknown target {target!r}; there are {', '.join(sorted(tx.TARGETS))}")
    footprint, height = tx.TARGETS[target]
    side = max(1, round(math.sqrt(footprint) / i.gsd))
    window = max(ROUGHNESS_PX, side)
    window += 1 - window % 2
    ground = i.slope.join(i.dim.select("class_id", "canopy"), "class_id")
    ground = ground.withColumn("shadow", (F.col("class_id") == tx.class_id("Shadow")).cast("int")).withColumn("built", F.col("class_id").isin(tx.ids(["House", "BrickWall"])))
    ground = grid.dilate(ground, "built", 9, "wide").withColumn("beside", (F.col("wide") & ~F.col("built")).cast("int"))
    for mask in ("shadow", "beside"):
        ground = target_cover(ground, mask, side, mask + "_cover")
    ground = grid.local_std(grid.local_std(ground, "slope", window, "rough"), "elev", window, "amplitude")
    top = ground.agg(F.max("rough").alias("top"))
    cover = F.greatest(F.pow("canopy", F.lit(min(1 + footprint / CLUMP_M2, EXPONENT_CAP))), SHADOW * F.col("shadow_cover"), BESIDE_BUILT * F.col("beside_cover"))
    relief = F.when(F.col("top") > 0, F.col("rough") / F.col("top") * clip01(F.col("amplitude") / height)).otherwise(0.0)
    return ground.join(F.broadcast(top)).select("r", "c", "class_id", "valid", clip01(cover + RELIEF * relief).alias("score"))

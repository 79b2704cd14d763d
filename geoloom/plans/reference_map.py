"""What a street and building map says about labels: expectations, trust, checks and evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..session import ensure_importable
from .audit import saturate

# Surface and grade of a way -> the road class it lets expect.
SURFACES = {
    "PavedRoad": "paved asphalt concrete concrete:plates concrete:lanes chipseal paving_stones sett cobblestone metal interlock interlocking bricks brick unhewn_cobblestone wood",
    "DirtRoad": "compacted gravel fine_gravel unpaved dirt earth ground mud",
    "DirtRoadB": "sand grass rock pebblestone woodchips",
}
GRADES = {"PavedRoad": "motorway trunk primary secondary tertiary residential living_street service", "DirtRoad": "unclassified track"}
# How complete a layer is thought to be, and how far a surface tag is believed.
RELIABILITY = {"road": 0.75, "building": 0.55, "water": 0.50, "barrier": 0.30, "footway": 0.35, "built_landuse": 0.45, "agri_landuse": 0.40, "other_highway": 0.40, "other": 0.20}
SURFACE_RELIABILITY = 0.80
# Axis -> scale of severity, support, contradiction.
AXES = {"existence": (1.00, 0.80, 0.20), "identity": (1.00, 0.85, 0.15), "state": (0.85, 0.62, 0.40)}
# Thresholds of the checks and of the evidence.
LEAST_WAY_PX, ROAD_AGREES, OCCLUDED, EXTRA_OVERLAP, BUILDING_AGREES, LEAST_BUILDING_PX, WATER_OVERLAP, MOST = 60, 0.20, 0.35, 0.15, 0.25, 30, 0.2, 0.85
STRONG, WEAK, NEAR_M = 0.50, 0.15, 25.0
# Metres each way of the shift search; cells a side of its tiles.
ALIGN_SEARCH_M, ALIGN_TILE = 6.0, 512


def expected_class(surface: Column, grade: Column) -> Column:
    """The road class a way's surface lets expect, else its grade."""
    table = lambda d: F.create_map(*(x for name, words in d.items() for w in words.split() for x in (F.lit(w), F.lit(name))))
    return F.coalesce(F.try_element_at(table(SURFACES), surface), F.try_element_at(table(GRADES), grade))


def blend(score: Column | float, reliability: float) -> Column:
    """A score pulled to the middle by how little a layer is to be believed."""
    return 0.5 + ((F.lit(score) if isinstance(score, float) else score) - 0.5) * reliability


def overlap(i, layer: DataFrame, name: str) -> DataFrame:
    """(region_id, name): the share of a region's cells in a layer, for regions that meet it."""
    n = i.cell_region.join(layer.select("r", "c").distinct(), ["r", "c"]).groupBy("region_id").agg(F.count("*").alias("n"))
    return n.join(i.region_ids.select("region_id", "area_px"), "region_id").select("region_id", (F.col("n") / F.col("area_px")).alias(name))


def missing_objects(i, footprints: DataFrame, class_ids: list[int], agrees: float = BUILDING_AGREES, least_px: int = LEAST_BUILDING_PX, layer: str = "building") -> DataFrame:
    """Mapped objects (obj_id, r, c) that the labels don't show."""
    under = footprints.join(i.valid.select("r", "c", "class_id"), ["r", "c"]).groupBy("obj_id").agg(F.count("*").alias("px"), (F.count_if(F.col("class_id").isin(class_ids)) / F.count("*")).alias("share"))
    return under.where((F.col("px") >= least_px) & (F.col("share") < agrees)).select("obj_id", "px", "share", F.least(F.lit(MOST), (1 - F.col("share")) * RELIABILITY[layer]).alias("severity"))


def extra_regions(i, layer: DataFrame, class_ids: list[int], most_overlap: float, least_m2: float, name: str) -> DataFrame:
    """Labelled regions that no mapped object explains."""
    rows = i.regions.where(F.col("class_id").isin(class_ids) & (F.col("area_m2") >= least_m2)).join(overlap(i, layer, "o"), "region_id", "left")
    o = F.coalesce("o", F.lit(0.0))
    return rows.where(o < most_overlap).select("region_id", "area_m2", o.alias("overlap"), F.least(F.lit(MOST), (1 - o) * RELIABILITY[name]).alias("severity"))


def grade_conflicts(i, ways: DataFrame, agrees: float = ROAD_AGREES) -> DataFrame:
    """Ways (way_id, expected, r, c) over labelled road of another grade: distance times share times belief in the surface."""
    roads = tx.ids(tx.SERIES["road"])
    under = ways.join(i.valid.select("r", "c", "class_id"), ["r", "c"]).groupBy("way_id", "expected", "class_id").agg(F.count("*").alias("px"))
    w = Window.partitionBy("way_id")
    share = under.withColumn("n", F.sum("px").over(w)).where(F.col("class_id").isin(roads))
    road = share.withColumn("road", F.sum("px").over(w) / F.col("n")).where((F.col("n") >= LEAST_WAY_PX) & (F.col("road") >= agrees))
    top = road.groupBy("way_id", "expected").agg(F.max_by(F.struct("class_id", "px", "n"), F.struct("px", -F.col("class_id"))).alias("t")).select("way_id", "expected", F.col("t.class_id").alias("found"), (F.col("t.px") / F.col("t.n")).alias("share"))
    names = F.create_map(*(x for n in tx.SERIES["road"] for x in (F.lit(n), F.lit(tx.class_id(n)))))
    met = top.withColumn("want", F.try_element_at(names, F.col("expected"))).join(i.pairs.select(F.col("a").alias("want"), F.col("b").alias("found"), "distance"), ["want", "found"])
    return met.where("distance > 0").select("way_id", "expected", "found", F.least(F.lit(MOST), F.col("distance") * F.col("share") * SURFACE_RELIABILITY).alias("severity"))


def reference_score(road: Column, building: Column, water: Column, cand_name: Column) -> Column:
    """How a map speaks for a candidate label of a region; null where it is silent.

    Overlaps are shares of the region, null or 0 where there is none.
    """
    r, b, w = (F.coalesce(x, F.lit(0.0)) for x in (road, building, water))
    silent = (r == 0) & (b == 0) & (w == 0)
    support = {k: v[1] for k, v in AXES.items()}
    against = {k: v[2] for k, v in AXES.items()}
    natural = cand_name.isin([x[2] for x in tx.rows() if x[3] in ("rock", "soil", "vegetation", "agriculture")])
    return (
        F.when(silent, None)
        .when(cand_name.isin(tx.SERIES["road"]), F.when(r >= WEAK, blend(support["existence"], 0.9 * RELIABILITY["road"])).otherwise(blend(against["existence"], 0.6 * RELIABILITY["road"])))
        .when(cand_name == "House", F.when(b >= WEAK, blend(support["state"], RELIABILITY["building"])).otherwise(0.5))
        .when(cand_name == "Water", F.when(w >= WEAK, blend(support["state"], RELIABILITY["water"])).otherwise(0.5))
        .when(natural & (r >= STRONG), blend(against["existence"], RELIABILITY["road"]))
        .when(natural & (b >= STRONG), blend(against["state"], RELIABILITY["building"]))
        .otherwise(0.5)
    )


def with_reference(own: Column, reference: Column) -> Column:
    """An adjudication total with the map's word: 0.7 own and 0.3 the map's, the middle where it is silent on a candidate."""
    return saturate(F.when(reference.isNull(), own).otherwise(0.7 * own + 0.3 * reference))


def shift_counts(ways: DataFrame, roads: DataFrame, gsd: float, search_m: float = ALIGN_SEARCH_M, tile: int = ALIGN_TILE) -> DataFrame:
    """(dr, dc, px): road cells that way cells meet when moved by each shift of up to search_m each way.

    Shifts that meet nothing have no row.  A tile gets its roads and the ways within reach of it,
    and hands on one count a shift.
    """
    ensure_importable(ways.sparkSession)
    reach = max(round(search_m / gsd), 1)

    def kernel(table: pa.Table) -> pa.Table:
        r, c, way = (table.column(n).to_numpy() for n in ("r", "c", "way"))
        r, c = r - r.min(), c - c.min()
        h, w = int(r.max()) + 1, int(c.max()) + 1
        under, road = np.zeros((h + 2 * reach, w + 2 * reach), bool), np.zeros((h, w), bool)
        under[r[way] + reach, c[way] + reach] = True
        road[r[~way], c[~way]] = True
        steps = range(-reach, reach + 1) if way.any() and not way.all() else []
        out = [(dr, dc, np.count_nonzero(road & under[reach - dr : reach - dr + h, reach - dc : reach - dc + w])) for dr in steps for dc in steps]
        return pa.table(dict(zip(("dr", "dc", "px"), (pa.array([x[k] for x in out if x[2]], pa.int64()) for k in range(3)))))

    tiles = lambda x, by: F.explode(F.sequence(F.floor((F.col(x) - by) / tile), F.floor((F.col(x) + by) / tile)))
    at = lambda cells, by, way: cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).withColumn("tr", tiles("r", by)).withColumn("tc", tiles("c", by)).withColumn("way", F.lit(way))
    both = at(ways, reach, True).unionByName(at(roads, 0, False))
    local = both.groupBy("tr", "tc").applyInArrow(kernel, "dr long, dc long, px long")
    return local.groupBy("dr", "dc").agg(F.sum("px").alias("px"))


def registration(shifts: DataFrame, gsd: float) -> str | None:
    """Verdict on shift_counts: the best shift, the first of equals, against none; null where no shift meets any road."""
    best = F.max_by(F.struct("dr", "dc"), F.struct("px", -F.col("dr"), -F.col("dc")))
    row = shifts.agg(best.alias("s"), F.max("px").alias("px"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("px"))).alias("zero")).first()
    return None if row.s is None else registered(row.zero or 0, row.px, float(np.hypot(row.s.dr, row.s.dc)) * gsd)


# The checks of a class that each burned layer makes possible; roads are always burned.
CHECKS = [
    *((c, "road", f"osm-road-{k}") for c in ("PavedRoad", "DirtRoad", "DirtRoadB") for k in ("missing", "occluded", "grade", "extra")),
    ("House", "building", "osm-building-missing"),
    ("House", "building", "osm-building-extra"),
    ("Water", "water", "osm-water-extra"),
    ("Water", "flow", "osm-water-extra"),
]


def checks_by_class(spark, layers: set[str]) -> DataFrame:
    """(class_id, check): what the burned layers can test, so that a silent check isn't read as a passed one."""
    rows = sorted({(tx.class_id(c), k) for c, layer, k in CHECKS if layer in layers | {"road"}})
    return spark.createDataFrame(rows, "class_id int, check string")


def registered(px_at_zero: int, best_px: int, best_shift_m: float, gain: float = 1.10, ok_m: float = 2.0, bad_m: float = 5.0) -> str:
    """Verdict of a shift search: only a clear, large gain elsewhere says misregistered."""
    if best_px < gain * max(px_at_zero, 1) or best_shift_m <= ok_m:
        return "OK"
    return "MISREGISTERED" if best_shift_m > bad_m else "DOUBTFUL"

"""Checks and evidence from a derived street and building map."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..plans import audit as au
from ..plans import reference_map as rm
from ..plans.index import index
from .audit_queries import audit
from .composition import R6
from .duck import sql

# Derived layers: 6 x 6 footprints every 20 cells, 8 x 8 ponds every 40.
FOOT, POND = "r % 20 < 6 and c % 20 < 6", "r % 40 between 10 and 17 and c % 40 between 30 and 37"
TAGGED = "(select way_id, r, c, case when way_id % 3 = 0 then 'asphalt' when way_id % 3 = 1 then 'gravel' end surface, case when way_id % 2 = 0 then 'residential' else 'track' end grade from way_cells)"
EXPECTED = "case when surface = 'asphalt' then 'PavedRoad' when surface = 'gravel' then 'DirtRoad' when grade = 'residential' then 'PavedRoad' else 'DirtRoad' end"


def footprints(i):
    return i.cells.where(FOOT).select((F.floor(F.col("r") / 20) * 1000 + F.floor(F.col("c") / 20)).alias("obj_id"), "r", "c")


def tagged(i):
    surface = F.when(F.col("way_id") % 3 == 0, "asphalt").when(F.col("way_id") % 3 == 1, "gravel")
    return i.way_cells.select("way_id", "r", "c", rm.expected_class(surface, F.when(F.col("way_id") % 2 == 0, "residential").otherwise("track")).alias("expected"))


@query("osm_building_missing", sql("cells", f"select obj_id, px, round(share, 6) share, round(least(0.85, (1 - share) * 0.55), 6) severity from (select r // 20 * 1000 + c // 20 obj_id, count(*) px, count(*) filter (class_id in (4, 3))::double / count(*) share from cells where valid and {FOOT} group by 1) q where px >= 30 and share < 0.25"))
def osm_building_missing(spark, d):
    i = index(spark, d)
    return rm.missing_objects(i, footprints(i), tx.ids(["House", "BrickWall"])).select("obj_id", "px", R6("share").alias("share"), R6("severity").alias("severity"))


def _extra(name: str, cls: str, layer: str, most: float, least: float, rel: float, spark_layer: str):
    @query(name, sql("regions", f"select region_id, round(coalesce(n, 0)::double / area_px, 6) overlap, round(least(0.85, (1 - coalesce(n, 0)::double / area_px) * {rel}), 6) severity from regions left join (select region_id, count(*) n from creg where {layer} group by 1) q using (region_id) where class_id = {tx.class_id(cls)} and area_m2 >= {least} and coalesce(n, 0)::double / area_px < {most}"))
    def run(spark, d):
        i = index(spark, d)
        return rm.extra_regions(i, i.cells.where(layer), tx.ids([cls]), most, least, spark_layer).select("region_id", R6("overlap").alias("overlap"), R6("severity").alias("severity"))


_extra("osm_building_extra", "House", FOOT, 0.15, 3.0, 0.55, "building")
_extra("osm_water_extra", "Water", POND, 0.2, 3.0, 0.5, "water")


@query("expected_road_class", sql("ways", f"select way_id, max({EXPECTED}) expected from {TAGGED} q group by 1"))
def expected_road_class(spark, d):
    return tagged(index(spark, d)).select("way_id", "expected").distinct()


@query("osm_road_grade", sql("ways pairs dim", f"""select way_id, expected, found, round(least(0.85, distance * share * 0.8), 6) severity from
 (select way_id, expected, class_id found, px::double / n share, row_number() over (partition by way_id order by px desc, class_id) k, sum(px) over (partition by way_id) / n road, n from
  (select way_id, {EXPECTED} expected, class_id, count(*) px, sum(count(*)) over (partition by way_id) n from {TAGGED} q join cells using (r, c) where valid group by 1, 2, 3) where class_id in (8, 9, 10)) t
 join dim on dim.name = expected join pairs p on p.a = dim.class_id and p.b = found where k = 1 and n >= 60 and road >= 0.02 and distance > 0"""))
def osm_road_grade(spark, d):
    i = index(spark, d)
    return rm.grade_conflicts(i, tagged(i), 0.02).select("way_id", "expected", "found", R6("severity").alias("severity"))


OVERLAPS = f"(select region_id, coalesce(count(*) filter (w.r is not null), 0)::double / count(*) road, count(*) filter (creg.{FOOT.replace(' and c', ' and creg.c')})::double / count(*) building, count(*) filter (creg.{POND.replace(' and c', ' and creg.c')})::double / count(*) water from creg left join (select distinct r, c from way_cells) w on w.r = creg.r and w.c = creg.c group by 1)"


def _overlaps(i):
    rows = i.region_ids.select("region_id", "class_id")
    for layer, name in ((i.road_cells, "road"), (i.cells.where(FOOT), "building"), (i.cells.where(POND), "water")):
        rows = rows.join(rm.overlap(i, layer, name), "region_id", "left")
    return rows.fillna(0.0, ["road", "building", "water"])


@query("region_context", sql("regions ways", f"select region_id, round(road, 6) road, round(building, 6) building, round(water, 6) water from {OVERLAPS} o"))
def region_context(spark, d):
    """Shares of each region under mapped roads, buildings and water."""
    return _overlaps(index(spark, d)).select("region_id", *(R6(n).alias(n) for n in ("road", "building", "water")))


NATURAL = "superclass in ('rock', 'soil', 'vegetation', 'agriculture')"
REF = f"case when road = 0 and building = 0 and water = 0 then null when name in ('DirtRoadB', 'DirtRoad', 'PavedRoad') then case when road >= 0.15 then 0.5 + 0.3 * 0.675 else 0.5 - 0.3 * 0.45 end when name = 'House' then case when building >= 0.15 then 0.5 + 0.12 * 0.55 else 0.5 end when name = 'Water' then case when water >= 0.15 then 0.5 + 0.12 * 0.5 else 0.5 end when {NATURAL} and road >= 0.5 then 0.5 - 0.3 * 0.75 when {NATURAL} and building >= 0.5 then 0.5 - 0.1 * 0.55 else 0.5 end"


@query("reference_score", sql("regions ways dim", f"select region_id, round({REF}, 6)::double score from {OVERLAPS} o join rid using (region_id) join dim using (class_id)"))
def reference_score(spark, d):
    """What the map says of each region's own label; null where it is silent."""
    i = index(spark, d)
    rows = _overlaps(i).join(i.dim.select("class_id", "name"), "class_id")
    return rows.select("region_id", R6(rm.reference_score(F.col("road"), F.col("building"), F.col("water"), F.col("name"))).alias("score"))


@query("osm_silent", sql("regions ways", f"select count(*) filter (road = 0 and building = 0 and water = 0) silent, count(*) n from {OVERLAPS} o"))
def osm_silent(spark, d):
    return _overlaps(index(spark, d)).agg(F.count_if(F.expr("road = 0 and building = 0 and water = 0")).alias("silent"), F.count("*").alias("n"))


@query("s2_with_reference")
def s2_with_reference(spark, d):
    """Adjudication totals with the map's word, for every candidate of every region."""
    i = index(spark, d)
    s = au.scores(audit(spark, d)).join(_overlaps(i).drop("class_id"), "region_id").join(F.broadcast(tx.dim_class(spark)).select(F.col("class_id").alias("cand"), "name"), "cand")
    ref = rm.reference_score(F.col("road"), F.col("building"), F.col("water"), F.col("name"))
    return s.select("region_id", "cand", R6(rm.with_reference(F.col("total"), ref)).alias("total"))


@query("block_label", sql("blocks", f"select root, array_to_string(list_slice(list_sort(list(distinct name)), 1, 3), ' / ') label from (select distinct root, 'street ' || way_id name from blk join way_cells w on abs(w.r - blk.r) <= 2 and abs(w.c - blk.c) <= 2) q group by 1"))
def block_label(spark, d):
    """Up to three street names around a block."""
    from .change_queries import block_way_bounds

    names = block_way_bounds(spark, d).select("root", F.concat(F.lit("street "), F.col("way_id").cast("string")).alias("name")).distinct()
    k = F.row_number().over(Window.partitionBy("root").orderBy("name"))
    return names.withColumn("k", k).where("k <= 3").groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("name")), " / ").alias("label"))


@query("vector_counts", sql("ways", f"select grade, count(distinct way_id) n from {TAGGED} q group by 1"))
def vector_counts(spark, d):
    return index(spark, d).ways.groupBy(F.when(F.col("way_id") % 2 == 0, "residential").otherwise("track").alias("grade")).agg(F.count("*").alias("n"))

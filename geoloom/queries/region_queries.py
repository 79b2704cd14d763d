"""Regions, adjacency, distances and the verb queries over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..operators import distance
from ..plans import verbs
from ..plans.index import CHIP, index
from ..sources.cells import GSD
from .composition import R6, with_more
from .duck import sql


@query("components", sql("comp", "select r, c, root from lroot"))
def components(spark, d):
    return index(spark, d).components.select("r", "c", "root")


@query("regions", sql("regions", "select region_id, class_id, root, area_px, perim_px, r0, c0, r1, c1, round(cy, 6) cy, round(cx, 6) cx, round(compactness, 6) compactness, round(elongation, 6) elongation from regions"))
def regions(spark, d):
    return index(spark, d).regions.select("region_id", "class_id", "root", "area_px", "perim_px", "r0", "c0", "r1", "c1", R6("cy").alias("cy"), R6("cx").alias("cx"), R6("compactness").alias("compactness"), R6("elongation").alias("elongation"))


@query("region_perimeter", sql("regions", "select region_id, perim_px, perimeter_m::double perimeter_m from regions"))
def region_perimeter(spark, d):
    return index(spark, d).regions.select("region_id", "perim_px", "perimeter_m")


@query("region_terrain", sql("regions", "select region_id, round(mean_slope, 5) mean_slope, round(std_slope, 4) std_slope, round(mean_elev, 5) mean_elev, round(aspect_circvar, 5) aspect_circvar from regions"))
def region_terrain(spark, d):
    return index(spark, d).regions.select("region_id", *(F.round(n, k).alias(n) for n, k in (("mean_slope", 5), ("std_slope", 4), ("mean_elev", 5), ("aspect_circvar", 5))))


@query("region_edges", sql("edges", "select a, b, shared_px from edges"))
def region_edges(spark, d):
    return index(spark, d).edges.select("a", "b", "shared_px")


@query("region_neighbor_hist", sql("nh", "select region_id, nbr_class, shared_px, round(share, 6) share from nh"))
def region_neighbor_hist(spark, d):
    return index(spark, d).neighbour_hist.select("region_id", "nbr_class", "shared_px", R6("share").alias("share"))


@query("l2_regions", sql("nh", "select region_id, rid.class_id, area_px, coalesce(nbrs, '') nbrs from rid left join (select region_id, string_agg(nbr_class || ':' || shared_px, ' ' order by shared_px desc, nbr_class) nbrs from (select *, row_number() over (partition by region_id order by shared_px desc, nbr_class) k from nh) where k <= 3 group by 1) q using (region_id)"))
def l2_regions(spark, d):
    """Regions with their three main neighbour classes."""
    i = index(spark, d)
    k = F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("shared_px"), "nbr_class"))
    top = i.neighbour_hist.withColumn("k", k).where("k <= 3").groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", F.col("nbr_class").cast("string"), F.col("shared_px").cast("string")).alias("s")))).alias("x"))
    text = top.select("region_id", F.array_join(F.transform("x", lambda x: x["s"]), " ").alias("nbrs"))
    return i.region_ids.join(text, "region_id", "left").select("region_id", "class_id", "area_px", F.coalesce("nbrs", F.lit("")).alias("nbrs"))


@query("l3_adjacency", sql("edges", "select a, b, shared_px * 0.5::double metres from edges where shared_px * 0.5 >= 1"))
def l3_adjacency(spark, d):
    return index(spark, d).edges.where(F.col("shared_px") * GSD >= 1).select("a", "b", (F.col("shared_px") * GSD).cast("double").alias("metres"))


@query("regions_by_class", sql("regions", "select region_id, area_px from rid where class_id = 4"))
def regions_by_class(spark, d):
    return index(spark, d).region_ids.where(F.col("class_id") == tx.class_id("House")).select("region_id", "area_px")


@query("find_minarea", sql("regions", "select region_id, area_m2::double area_m2 from regions where class_id = 4 and area_m2 >= 4"))
def find_minarea(spark, d):
    return verbs.run(index(spark, d), "find House minarea 4").rows.select("region_id", "area_m2")


@query("find_slope", sql("regions", "select region_id from regions where class_id = 23 and mean_slope > 40"))
def find_slope(spark, d):
    return verbs.run(index(spark, d), "find Batha slope > 40").rows.select("region_id")


@query("count_class", sql("regions", "select count(*) n, coalesce(sum(area_m2), 0)::double area_m2 from regions where class_id = 11"))
def count_class(spark, d):
    return verbs.run(index(spark, d), "count Water").rows


@query("area_class", sql("regions", "select coalesce(sum(area_m2), 0)::double area_m2 from regions where class_id = 25"))
def area_class(spark, d):
    return verbs.run(index(spark, d), "area Maquis").rows


@query("near_filter", sql("regions", "select region_id from regions x where class_id = 4 and exists (select 1 from cells y where valid and class_id = 8 and (y.r - floor(x.cy)) ** 2 + (y.c - floor(x.cx)) ** 2 <= 100)"))
def near_filter(spark, d):
    """Regions whose centroid's cell has a road cell within 5 m: an exact nearest-distance join."""
    return verbs.run(index(spark, d), "find House near PavedRoad 5").rows.select("region_id")


@query("distance_pair", sql("cells", "select min((x.r - y.r) ** 2 + (x.c - y.c) ** 2)::bigint d2 from cells x, cells y where x.valid and y.valid and x.class_id = 4 and y.class_id = 11"))
def distance_pair(spark, d):
    return verbs.run(index(spark, d), "distance House Water").rows.select("d2")


@query("distance_witness", sql("cells", "select x.r ar, x.c ac, y.r br, y.c bc, ((x.r - y.r) ** 2 + (x.c - y.c) ** 2)::bigint d2 from cells x, cells y where x.valid and y.valid and x.class_id = 4 and y.class_id = 11 order by d2, br, bc, ar, ac limit 1"))
def distance_witness(spark, d):
    """The two cells of closest approach; ties to the first cell of the second class, then of the first."""
    return verbs.run(index(spark, d), "distance House Water").rows.select("ar", "ac", "br", "bc", "d2")


@query("nearest_d2", sql("cells", "select x.r, x.c, min((x.r - y.r) ** 2 + (x.c - y.c) ** 2)::bigint d2 from cells x, (select r, c from cells where valid and class_id = 11) y group by 1, 2"))
def nearest_d2(spark, d):
    cells = index(spark, d).cells.withColumn("seed", F.expr("valid and class_id = 11"))
    return distance.nearest_d2(cells, "seed").select("r", "c", "d2")


@query("chip_anchor_d2", sql("chips", f"select chip_r, chip_c, y.class_id anchor, min((x.r - y.r) ** 2 + (x.c - y.c) ** 2)::bigint d2 from cells x join chips on chip_r = x.r // {CHIP} and chip_c = x.c // {CHIP}, (select r, c, class_id from cells where valid and class_id in ({', '.join(map(str, tx.ids(tx.ANCHORS)))})) y group by 1, 2, 3"))
def chip_anchor_d2(spark, d):
    return index(spark, d).chip_anchor.where("d2 is not null").select("chip_r", "chip_c", "anchor", "d2")


@query("corridor_components", with_more("slope dim", """
 ok as (select r, c, traffic * greatest(0, least(1, 1 - (slope - 5) / 40.0)) s from sl join dim using (class_id) where valid and traffic >= 0.5),
 tr as (select r * 1000 + c u, r, c from ok where s >= 0.2),
 tl as (select a.u, b.u v from tr a join (select unnest([-1, 0, 1]) dr) x on true join (select unnest([-1, 0, 1]) dc) y on true join tr b on b.r = a.r + dr and b.c = a.c + dc),
 tz as (select u, v from tl union select tz.u, tl.v from tz join tl on tz.v = tl.u),
 tc as (select u, min(v) root from tz group by u)""", "select root, count(*) px from tc group by 1"))
def corridor_components(spark, d):
    return verbs.passable_pieces(index(spark, d), "foot", 0.2, 0.5, 1).groupBy("root").agg(F.count("*").alias("px"))


@query("corridor_summary")
def corridor_summary(spark, d):
    return verbs.run(index(spark, d), "corridor PavedRoad vehicle wheeled").rows


@query("describe_verb", sql("cells dim", "select name, count(*) px from cells join dim using (class_id) where valid group by 1"))
def describe_verb(spark, d):
    return verbs.run(index(spark, d), "describe").rows.select("name", "px")


@query("fragmentation", sql("regions", "select count(*) n, count(*) filter (area_px < 32) n_small, round(count(*) filter (area_px < 32)::double / count(*), 6) share_regions, round(sum(area_px) filter (area_px < 32)::double / sum(area_px), 6) share_area, quantile_cont(area_px, 0.5)::double median_px from rid"))
def fragmentation(spark, d):
    small = F.col("area_px") < 32
    return index(spark, d).region_ids.agg(F.count("*").alias("n"), F.count_if(small).alias("n_small"), R6(F.count_if(small) / F.count("*")).alias("share_regions"), R6(F.sum(F.when(small, F.col("area_px"))) / F.sum("area_px")).alias("share_area"), F.percentile("area_px", F.lit(0.5)).alias("median_px"))


@query("merge_check", sql("regions", "select class_id, count(*) n, max(area_px) largest, (list_sort(list(area_px)))[count(*) // 2 + 1] upper_median, round(max(area_px)::double / sum(area_px), 6) top_share from rid group by 1"))
def merge_check(spark, d):
    """Whether regions of a class look fused: the upper median and the share of the largest."""
    w = Window.partitionBy("class_id")
    r = index(spark, d).region_ids.withColumn("k", F.row_number().over(w.orderBy("area_px", "region_id"))).withColumn("n", F.count("*").over(w))
    return r.groupBy("class_id", "n").agg(F.max("area_px").alias("largest"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("area_px"))).alias("upper_median"), R6(F.max("area_px") / F.sum("area_px")).alias("top_share"))


@query("dense_renumber", sql("regions", "select root, region_id from rid"))
def dense_renumber(spark, d):
    return index(spark, d).region_ids.select("root", "region_id")


@query("sort_area", sql("regions", "select region_id, area_px from rid order by area_px desc, region_id"))
def sort_area(spark, d):
    return index(spark, d).region_ids.orderBy(F.desc("area_px"), "region_id").select("region_id", "area_px")


@query("evidence_cap", sql("regions", "select class_id, array_to_string(list_slice(list_sort(list(region_id)), 1, 25), ',') ids, count(*) total from rid group by 1"))
def evidence_cap(spark, d):
    """The first 25 ids as evidence, with how many there are."""
    r = index(spark, d).region_ids.withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy("region_id")))
    return r.groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 25, F.col("region_id")))), ",").alias("ids"), F.count("*").alias("total"))

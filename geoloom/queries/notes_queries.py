"""Notes joined to the map, blocks worth a look, and what checks and policies can say at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..plans import audit as au
from ..plans import products, reference_map, triage
from ..plans.index import index
from ..sources import notes
from ..sources.cells import PIXEL_M2
from .audit_queries import CAND, audit
from .change_queries import ANCH, APP, KEY, _app_sql, policy_sql
from .composition import R6, box_sql, with_more
from .duck import sql

#: The notes these queries join: four sections, one of them for no class.
NOTES = """## House
definition: roofed building
looks_like: bright rectangle
confused_with: PavedRoad - flat roofs; Water - sheen; Tower - not a class
## Water
confused_with: Shadow
season: -
## Rendzina
definition: (seed) soil on chalk
quality: fair
## Tower
definition: no class
"""
ROWS = notes.parse(NOTES)
# The same, written out for the reference SQL.
CONFUSED = f"(values ({tx.class_id('House')}, {tx.class_id('PavedRoad')}), ({tx.class_id('House')}, {tx.class_id('Water')}), ({tx.class_id('Water')}, {tx.class_id('Shadow')})) t(k, cand)"
FILLED = f"(values ({tx.class_id('House')}, 3, 'roofed building'), ({tx.class_id('Water')}, 1, null), ({tx.class_id('Rendzina')}, 1, null)) t(class_id, filled, definition)"


@query("s2_candidates_noted", sql("nh pairs", f"select region_id, cand from {CAND} c union select region_id, t.cand from rid join {CONFUSED} on k = class_id"))
def s2_candidates_noted(spark, d):
    """The shortlist of each region with what analysts have seen confused."""
    return au.candidates(audit(spark, d), notes.confused(spark, ROWS)).select("region_id", "cand")


@query("notes_coverage", sql("cells dim", f"select class_id, name, coalesce(px, 0) px, coalesce(filled, 0) filled from dim left join (select class_id, count(*) px from cells where valid group by 1) h using (class_id) left join (select class_id, filled from {FILLED}) f using (class_id)"))
def notes_coverage(spark, d):
    i = index(spark, d)
    hist = i.valid.groupBy("class_id").agg(F.count("*").alias("px"))
    return notes.coverage(hist, i.dim, notes.fields_filled(spark, ROWS))


@query("legend_with_notes", sql("dim", f"select class_id, name, definition from dim left join (select class_id, definition from {FILLED}) f using (class_id)"))
def legend_with_notes(spark, d):
    return tx.dim_class(spark).join(notes.fields_filled(spark, ROWS).select("class_id", "definition"), "class_id", "left").select("class_id", "name", "definition")


@query("interesting_blocks", sql("blocks", "select count(*) n, count(*) filter (a >= 200) n_large, max(a)::double largest, median(a)::double median, min(a)::double least, round(sum(a) filter (a >= 200) / sum(a), 6)::double share from (select count(*) * 0.25 a from blk group by root) q"))
def interesting_blocks(spark, d):
    """Blocks of 200 m2 or more, how much of all block ground they hold, and the spread of sizes."""
    a = index(spark, d).blocks.groupBy("root").agg((F.count("*") * PIXEL_M2).cast("double").alias("a"))
    large = F.col("a") >= 200
    return a.agg(F.count("*").alias("n"), F.count_if(large).alias("n_large"), F.max("a").alias("largest"), F.expr("percentile(a, 0.5)").alias("median"), F.min("a").alias("least"), R6(F.sum(F.when(large, F.col("a"))) / F.sum("a")).alias("share"))


WINDOW = "r between 40 and 79 and c between 40 and 119"


@query("window_quotable", sql("blocks", f"select root, count(*) filter ({WINDOW})::double / count(*) >= 0.9 quotable, count(*) filter ({WINDOW})::double / count(*) < 0.999 truncated from blk group by 1 having count(*) filter ({WINDOW}) > 0"))
def window_quotable(spark, d):
    """Whether a window holds enough of a block for its figures to be quoted, and whether the block goes on outside."""
    share = F.count_if(F.expr(WINDOW)) / F.count("*")
    return index(spark, d).blocks.groupBy("root").agg(share.alias("share")).where("share > 0").select("root", (F.col("share") >= 0.9).alias("quotable"), (F.col("share") < 0.999).alias("truncated"))


_ROAD_CHECKS = ["osm-road-missing", "osm-road-occluded", "osm-road-grade", "osm-road-extra"]
_BY_HAND = [(c, k) for c in ("PavedRoad", "DirtRoad", "DirtRoadB") for k in _ROAD_CHECKS] + [("House", "osm-building-missing"), ("House", "osm-building-extra")]


@query("checks_by_class", sql("dim", 'select class_id, "check" from dim join (values ' + ", ".join(f"('{c}', '{k}')" for c, k in _BY_HAND) + ') t(n, "check") on n = name'))
def checks_by_class(spark, d):
    return reference_map.checks_by_class(spark, {"road", "building"})


@query("target_cover", with_more("cells", box_sql("b", "cells", "(class_id = 4)::int", 5), "select r, round(sum(v) / 25, 6)::double total from b3 group by r"))
def target_cover(spark, d):
    """How much of a 4-cell target's surroundings House covers, by row."""
    cells = index(spark, d).cells.withColumn("house", (F.col("class_id") == 4).cast("int"))
    return products.target_cover(cells, "house", 4, "cover").groupBy("r").agg(R6(F.sum("cover")).alias("total"))


@query("weight_vector", sql("dim", "select class_id, case name " + " ".join(f"when '{n}' then {w}" for n, w in APP.class_weights.items()) + " else 0 end::double weight from dim"))
def weight_vector(spark, d):
    return triage.weight_vector(APP, index(spark, d).dim)


@query("s3_n_not_applicable", with_more("chips", " " + ANCH, f"select count(*) n from (select *, row_number() over (order by excluded, round(score, 9) desc, chip_r, chip_c) rank, greatest(1, round_even(count(*) over () * 0.2, 0)) k from {policy_sql(APP)} s) z join {_app_sql(APP)} a using (chip_r, chip_c) where not (rank <= k and not excluded) and applicability < {triage.APPLICABLE_MIN}"))
def s3_n_not_applicable(spark, d):
    i = index(spark, d)
    u = triage.units(i)
    return triage.not_applicable(triage.select(triage.score(APP, i.chip_frac, u, KEY), KEY), triage.applicability(APP, i.chip_frac, u, KEY), KEY)


@query("product_keys", "select unnest(['built_fabric', 'change_volatility', 'concealment', 'trafficability', 'traversability']) product, unnest([0, 1, 2, 3, 4])::int place")
def product_keys(spark, d):
    return spark.createDataFrame([(n, k) for k, n in enumerate(products.product_keys())], "product string, place int")


@query("request_aoi", sql("cells", "select class_id, count(*) n from cells where valid and r >= 20 and c < 100 group by 1"))
def request_aoi(spark, d):
    """What a provider is asked about: valid cells of a mask."""
    cells = index(spark, d).cells
    mask = cells.where("r >= 20 and c < 100").select("r", "c")
    return cells.where("valid").join(mask, ["r", "c"], "left_semi").groupBy("class_id").agg(F.count("*").alias("n"))

"""Change, tiles, triage, ways and blocks."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..plans import change, products, reference_map, triage
from ..plans.index import CHIP, TILE, index
from ..sources.cells import GSD, PIXEL_M2
from ..sources import vectors
from .audit_queries import ALL, audit
from .composition import R6, with_more
from .duck import sql


@cache
def _change(i) -> change.Change:
    return change.Change(i)


CHG = "(select x.class_id a, x.class_id2 b, count(*) px from cells x where valid and valid2 and class_id <> class_id2 group by 1, 2)"


@query("change_pairs", sql("cells", f"select a, b, px, (px * 0.25)::double area_m2 from {CHG} q"))
def change_pairs(spark, d):
    return _change(index(spark, d)).pairs().select("a", "b", "px", (F.col("px") * PIXEL_M2).cast("double").alias("area_m2"))


@query("change_events", sql("cells pairs", f"select q.a, q.b, category, px from {CHG} q join pairs p on p.a = q.a and p.b = q.b where px * 0.25 >= 20"))
def change_events(spark, d):
    return _change(index(spark, d)).events().select("a", "b", "category", "px")


@query("change_categories", sql("cells pairs", f"select category, sum(px)::bigint px, count(*) n_pairs from {CHG} q join pairs p on p.a = q.a and p.b = q.b group by 1"))
def change_categories(spark, d):
    return _change(index(spark, d)).pairs().groupBy("category").agg(F.sum("px").alias("px"), F.count("*").alias("n_pairs"))


@query("change_components", with_more("cells", """
 ch as (select r * 1000 + c u, r, c, class_id * 47 + class_id2 k from cells where valid and valid2 and class_id <> class_id2),
 cl as (select a.u, b.u v from ch a join (select unnest([-1, 0, 1]) dr) x on true join (select unnest([-1, 0, 1]) dc) y on true join ch b on b.r = a.r + dr and b.c = a.c + dc and a.k = b.k),
 cz as (select u, v from cl union select cz.u, cl.v from cz join cl on cz.v = cl.u),
 cc as (select u, min(v) root from cz group by u)""", "select (k // 47)::int a, (k % 47)::int b, count(distinct root) components from ch join cc using (u) group by 1, 2"))
def change_components(spark, d):
    return _change(index(spark, d)).components


@query("coverage_change", sql("cells", "select count(*) filter (valid and valid2) covalid, count(*) filter (valid and valid2 and class_id <> class_id2) changed, count(*) filter (valid <> valid2) one_sided, count(*) filter (valid or valid2) seen from cells"))
def coverage_change(spark, d):
    return _change(index(spark, d)).summary()


@query("transition_dim", sql("pairs", "select category, count(*) n from pairs group by 1"))
def transition_dim(spark, d):
    return tx.dim_class_pair(spark).groupBy("category").agg(F.count("*").alias("n"))


@query("second_date", sql("cells", "select class_id2, count(*) px from cells group by 1"))
def second_date(spark, d):
    return index(spark, d).cells.groupBy("class_id2").agg(F.count("*").alias("px"))


def _tiles(v: str, ok: str) -> str:
    return f"(select r // {TILE} tile_r, c // {TILE} tile_c, {v} class_id, count(*) px, sum(count(*)) over (partition by r // {TILE}, c // {TILE}) n, count(*)::double / sum(count(*)) over (partition by r // {TILE}, c // {TILE}) frac, row_number() over (partition by r // {TILE}, c // {TILE} order by count(*) desc, {v}) k from cells where {ok} group by 1, 2, 3)"


TA, TB = _tiles("class_id", "valid"), _tiles("class_id2", "valid2")


@query("tile_rollup_classes", sql("cells", f"select tile_r, tile_c, class_id, round(frac, 6) frac from {TA} t where k <= 4"))
def tile_rollup_classes(spark, d):
    return change.tile_rollup(index(spark, d)).select("tile_r", "tile_c", F.explode("classes").alias("class_id", "f")).select("tile_r", "tile_c", "class_id", R6("f").alias("frac"))


@query("tile_rollup_products", sql("cells dim", f"select tile_r, tile_c, round(sum(frac) filter (k > 4), 6) rest, round(sum(frac * volatility), 6) volatility from {TA} t join dim using (class_id) group by 1, 2"))
def tile_rollup_products(spark, d):
    return change.tile_rollup(index(spark, d)).select("tile_r", "tile_c", R6("rest").alias("rest"), R6("volatility").alias("volatility"))


DIFF = f"""(select tile_r, tile_c, va, vb, 0.5 * sum(case when fa is null then greatest(0, fb - ra) when fb is null then greatest(0, fa - rb) else abs(fa - fb) end) shift,
 greatest(sum(greatest(0, mv)), sum(greatest(0, -mv))) structural from
 (select coalesce(x.tile_r, y.tile_r) tile_r, coalesce(x.tile_c, y.tile_c) tile_c, x.frac fa, y.frac fb, case when coalesce(x.class_id, y.class_id) in ({', '.join(map(str, tx.ids(tx.BUILT)))}) then coalesce(y.frac, 0) - coalesce(x.frac, 0) else 0 end mv
  from (select * from {TA} t where k <= 4) x full join (select * from {TB} t where k <= 4) y on x.tile_r = y.tile_r and x.tile_c = y.tile_c and x.class_id = y.class_id) q
 join (select tile_r, tile_c, coalesce(sum(frac) filter (k > 4), 0) ra, sum(frac * volatility) va from {TA} t join dim using (class_id) group by 1, 2) m using (tile_r, tile_c)
 join (select tile_r, tile_c, coalesce(sum(frac) filter (k > 4), 0) rb, sum(frac * volatility) vb from {TB} t join dim using (class_id) group by 1, 2) n using (tile_r, tile_c) group by 1, 2, 3, 4)"""
EXC = "shift * greatest(1 - 0.5 * (va + vb), 0)"
VER = f"case when round(structural, 9) >= 0.05 then 'structural' when round(shift, 9) < 0.08 then 'quiet' when round({EXC}, 9) >= 0.12 then 'worth-a-look' else 'expected' end"


@query("tile_diff", sql("cells dim", f"select tile_r, tile_c, round(shift, 5) shift, round({EXC}, 5) excess, round(structural, 5) structural, {VER} verdict from {DIFF} z"))
def tile_diff(spark, d):
    return change.tile_diff(index(spark, d))


@query("tile_verdict_counts", sql("cells dim", f"select {VER} verdict, count(*) n from {DIFF} z group by 1"))
def tile_verdict_counts(spark, d):
    return change.tile_diff(index(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("tile_movers", sql("cells", f"select tile_r, tile_c, class_id, delta from (select *, row_number() over (partition by tile_r, tile_c order by delta desc, class_id) k from (select coalesce(x.tile_r, y.tile_r) tile_r, coalesce(x.tile_c, y.tile_c) tile_c, coalesce(x.class_id, y.class_id) class_id, round(coalesce(y.frac, 0) - coalesce(x.frac, 0), 6) delta from {TA} x full join {TB} y on x.tile_r = y.tile_r and x.tile_c = y.tile_c and x.class_id = y.class_id) where delta > 0) where k <= 3"))
def tile_movers(spark, d):
    return change.tile_movers(index(spark, d)).select("tile_r", "tile_c", "class_id", "delta")


@query("region_to_tile", sql("regions", f"select floor(floor(cy) / {TILE})::bigint tile_r, floor(floor(cx) / {TILE})::bigint tile_c, count(*) n, sum(area_px)::bigint px from regions group by 1, 2"))
def region_to_tile(spark, d):
    return index(spark, d).regions.groupBy(F.floor(F.floor("cy") / TILE).alias("tile_r"), F.floor(F.floor("cx") / TILE).alias("tile_c")).agg(F.count("*").alias("n"), F.sum("area_px").alias("px"))


CAUSES = f"select floor(floor(cy) / {TILE})::bigint tile_r, floor(floor(cx) / {TILE})::bigint tile_c, cause, count(*) n from {ALL} f join regions using (region_id) group by 1, 2, 3"


@query("tile_rollup_findings", sql("nh dim pairs", f"""select tile_r, tile_c, '[' || string_agg('{{"k":' || k || ',"cause":"' || cause || '","n":' || n || '}}', ',' order by k) || ']' causes
 from (select *, row_number() over (partition by tile_r, tile_c order by n desc, cause) k from ({CAUSES}) q) z where k <= 3 group by 1, 2"""))
def tile_rollup_findings(spark, d):
    """Findings per tile with the three main causes, by the regions' centroids."""
    i = index(spark, d)
    at = i.regions.select("region_id", F.floor(F.floor("cy") / TILE).alias("tile_r"), F.floor(F.floor("cx") / TILE).alias("tile_c"))
    n = audit(spark, d).findings.join(at, "region_id").groupBy("tile_r", "tile_c", "cause").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("tile_r", "tile_c").orderBy(F.desc("n"), "cause"))
    return n.withColumn("k", k).where("k <= 3").groupBy("tile_r", "tile_c").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "cause", "n")))).alias("causes"))


@query("chip_to_tile", sql("chips", f"select (chip_r * {CHIP} + {CHIP // 2}) // {TILE} tile_r, (chip_c * {CHIP} + {CHIP // 2}) // {TILE} tile_c, count(*) n, round(max(entropy), 6) top_entropy from chips group by 1, 2"))
def chip_to_tile(spark, d):
    mid = lambda n: F.floor((F.col(n) * CHIP + CHIP // 2) / TILE)
    return index(spark, d).chips.groupBy(mid("chip_r").alias("tile_r"), mid("chip_c").alias("tile_c")).agg(F.count("*").alias("n"), R6(F.max("entropy")).alias("top_entropy"))


# ---- triage --------------------------------------------------------------------------------------

KEY = ["chip_r", "chip_c"]


def _scored(i, name: str):
    return triage.score(triage.BUILTIN[name], i.chip_frac, triage.units(i), KEY)


def _in(names) -> str:
    return ", ".join(map(str, tx.ids(names)))


ANCH = f"anc as (select chip_r, chip_c, y.class_id anchor, sqrt(min((x.r - y.r) ** 2 + (x.c - y.c) ** 2)) * 0.5 m from cells x join chips on chip_r = x.r // {CHIP} and chip_c = x.c // {CHIP}, (select r, c, class_id from cells where valid and class_id in ({_in(tx.ANCHORS)})) y group by 1, 2, 3)"


def score_sql(name: str) -> str:
    return policy_sql(triage.BUILTIN[name])


def policy_sql(p) -> str:
    w = "case class_id " + " ".join(f"when {tx.class_id(n)} then {v}" for n, v in p.class_weights.items()) + " else 0 end"
    ent = triage.ENTROPY_WEIGHT.get(p.regime.split("+")[0], 0.15)
    rules = ["1"]
    for text, factor in p.rules:
        if text.startswith("dist_to."):
            cls, limit = text[8:].split(" < ")
            rules.append(f"case when coalesce((select m from anc where anc.chip_r = q.chip_r and anc.chip_c = q.chip_c and anchor = {tx.class_id(cls)}), 1e9) < {limit} then {factor} else 1 end")
        elif text.startswith("entropy"):
            rules.append(f"case when {text} then {factor} else 1 end")
    return f"(select chip_r, chip_c, ex_frac > 0.8 excluded, case when ex_frac > 0.8 then 0 else mass * (1 - ex_frac) * {' * '.join(rules)} * (1 + {ent} * entropy / 4.0) end score from (select chip_r, chip_c, sum({w} * frac) mass, coalesce(sum(frac) filter (class_id in ({_in(p.hard_exclude) or -1})), 0) ex_frac from chip_frac group by 1, 2) q join chips using (chip_r, chip_c))"


for _p in triage.BUILTIN:

    @query(f"s3_score_{_p}", with_more("chips", " " + ANCH, f"select chip_r, chip_c, excluded, round(score, 5)::double score from {score_sql(_p)} s"))
    def s3_score(spark, d, name=_p):
        return _scored(index(spark, d), name).select(*KEY, "excluded", F.round("score", 5).alias("score"))


SEL = f"(select *, row_number() over (order by excluded, round(score, 9) desc, chip_r, chip_c) rank, greatest(1, round_even(count(*) over () * 0.2, 0)) k from {score_sql('structures')} s)"


@query("s3_selected", with_more("chips", " " + ANCH, f"select chip_r, chip_c, rank from {SEL} z where rank <= k and not excluded"))
def s3_selected(spark, d):
    return triage.select(_scored(index(spark, d), "structures"), KEY).where("selected").select(*KEY, F.col("rank").cast("long").alias("rank"))


@query("s3_excluded", with_more("chips", " " + ANCH, f"select excluded, count(*) n from {score_sql('vehicles')} s group by 1"))
def s3_excluded(spark, d):
    return _scored(index(spark, d), "vehicles").groupBy("excluded").agg(F.count("*").alias("n"))


@query("s3_captured", with_more("chips", " " + ANCH, f"select round(sum(score) filter (rank <= k and not excluded) / sum(score), 6) captured, count(*) n from {SEL} z"))
def s3_captured(spark, d):
    s = triage.select(_scored(index(spark, d), "structures"), KEY)
    return s.agg(R6(F.sum(F.when(F.col("selected"), F.col("score"))) / F.sum("score")).alias("captured"), F.count("*").alias("n"))


@query("s3_control_set")
def s3_control_set(spark, d):
    """What is looked at although it was rejected: a hash order, the same every time."""
    return triage.select(_scored(index(spark, d), "structures"), KEY).where("control").select(*KEY)


LOOKED = f"(select count(*) n, count(*) filter (excluded) ex, count(*) filter (rank <= k and not excluded) chosen, any_value(k) k from {SEL} z)"


@query("s3_cost_reduction", with_more("chips", " " + ANCH, f"select 1 - looked::double / n cost_reduction, 1 - looked::double / (n - ex) cost_reduction_searchable from (select *, chosen + least(n - chosen, greatest(1, round_even((n - k) * 0.03, 0))) looked from {LOOKED} q)"))
def s3_cost_reduction(spark, d):
    s = triage.select(_scored(index(spark, d), "structures"), KEY)
    looked = F.count_if(F.col("selected") | F.col("control"))
    return s.agg((1 - looked / F.count("*")).alias("cost_reduction"), (1 - looked / F.count_if(~F.col("excluded"))).alias("cost_reduction_searchable"))


APP = triage.compile_query("find missing trees near water")


def _app_sql(p) -> str:
    hab = [c for c in p.context_classes if c not in p.applies_to]
    near = [n for n in [*p.applies_to, *p.context_classes] if n in tx.ANCHORS]
    return f"(select chip_r, chip_c, least(1, greatest(t, h, 0.5 * coalesce((select greatest(0, 1 - min(m) / 120.0) from anc where anc.chip_r = q.chip_r and anc.chip_c = q.chip_c and anchor in ({_in(near)})), 0))) applicability from (select chip_r, chip_c, coalesce(sum(frac) filter (class_id in ({_in(p.applies_to)})), 0) t, coalesce(sum(0.45 * frac) filter (class_id in ({_in(hab)})), 0) h from chip_frac group by 1, 2) q)"


def _absence_sql(p) -> str:
    there = f"(select chip_r, chip_c, coalesce(sum(frac) filter (class_id in ({_in(p.applies_to)})), 0) t from chip_frac group by 1, 2)"
    return f"select chip_r, chip_c, round(applicability * score * (1 - t), 6)::double as value from {_app_sql(p)} a join {policy_sql(p)} s using (chip_r, chip_c) join {there} h using (chip_r, chip_c) where applicability >= {triage.APPLICABLE_MIN}"


@query("s3_applicability", with_more("chips", " " + ANCH, f"select chip_r, chip_c, round(applicability, 6)::double applicability from {_app_sql(APP)} z"))
def s3_applicability(spark, d):
    i = index(spark, d)
    return triage.applicability(APP, i.chip_frac, triage.units(i), KEY).select(*KEY, R6("applicability").alias("applicability"))


@query("s3_absence_score", with_more("chips", " " + ANCH, _absence_sql(APP)))
def s3_absence_score(spark, d):
    """Where what is asked for is missing though the ground suits it: applicability * priority * (1 - presence)."""
    i = index(spark, d)
    app, s = triage.applicability(APP, i.chip_frac, triage.units(i), KEY), triage.score(APP, i.chip_frac, triage.units(i), KEY)
    both = app.join(s, KEY).withColumn("value", F.col("applicability") * F.col("score") * (1 - F.col("t")))
    return both.where(F.col("applicability") >= triage.APPLICABLE_MIN).select(*KEY, R6("value").alias("value"))


@query("rule_predicate", sql("chips", "select count(*) filter (entropy > 2.5) a, 0::bigint b, count(*) filter (n_classes >= 10) c from chips"))
def rule_predicate(spark, d):
    """Rules of the mini-language; one that can't be parsed or measured holds nowhere."""
    u = index(spark, d).chips
    test = lambda t: F.count_if(triage.rule_column(t, set(u.columns)))
    return u.agg(test("entropy > 2.5").alias("a"), test("osm.dist_road < 30").alias("b"), test("n_classes >= 10").alias("c"))


@query("compile_query")
def compile_query(spark, d):
    asked = ["find missing trees near water", "vehicles along paved roads", "greenhouses in the badlands"]
    rows = [(q, triage.compile_query(q).to_json(), triage.compile_query(q).understood()) for q in asked]
    return spark.sql("select * from values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + " as t(query, policy, understood)")


# ---- ways and blocks -----------------------------------------------------------------------------


@query("burn_axis_ways", sql("ways", "select way_id, count(*) px, sum(r * 31 + c)::bigint chk from way_cells group by 1"))
def burn_axis_ways(spark, d):
    return index(spark, d).way_cells.groupBy("way_id").agg(F.count("*").alias("px"), F.sum(F.col("r") * 31 + F.col("c")).alias("chk"))


# Tagged polylines, one a nation, for the burner: the widths below are written out, not taken from the library.
_HIGHWAYS = ["motorway", "trunk", "primary_link", "residential", "track", "steps", "unclassified"]
_HALF = "case when k % 5 = 0 then 3.0 when k % 5 = 1 then case k % 7 when 0 then 11.0 when 1 then 8.0 when 2 then 7.0 when 3 then 7.0 when 4 then 7.0 when 5 then 7.0 else 7.0 end else case k % 7 when 0 then 11.0 when 1 then 8.0 when 2 then 7.0 when 3 then 4.0 when 4 then 2.5 when 5 then 1.0 else 4.0 end end"
_POINTS = ["k * 3 % h", "5.25", "(k * 17 + 40) % h", "100.5", "k * 29 % h", "190.75"]
_SEGMENTS = f"""
 pts as (select n_nationkey::bigint k, h from nation, (select max(r) + 1 h from cells) e),
 seg as (select k, 2 * ({_HALF}) half, ({_POINTS[0]})::double r0, {_POINTS[1]}::double c0, ({_POINTS[2]})::double r1, {_POINTS[3]}::double c1 from pts
  union all select k, 2 * ({_HALF}), ({_POINTS[2]})::double, {_POINTS[3]}::double, ({_POINTS[4]})::double, {_POINTS[5]}::double from pts),
 tt as (select *, greatest(0, least(1, ((r + 0.5 - r0) * (r1 - r0) + (c + 0.5 - c0) * (c1 - c0)) / ((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0)))) t from seg join cells on r between floor(least(r0, r1) - half) and floor(greatest(r0, r1) + half)),
 burned as (select distinct k way_id, r, c from tt where (r + 0.5 - r0 - t * (r1 - r0)) ** 2 + (c + 0.5 - c0 - t * (c1 - c0)) ** 2 <= half * half)"""


def _tagged_ways(spark, d):
    """(way_id, tags, rows, cols): bent ways across the grid, some with a width, some with lanes."""
    high = index(spark, d).cells.agg((F.max("r") + 1).alias("h"))
    k = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k")).join(F.broadcast(high))
    highway = F.element_at(F.array(*map(F.lit, _HIGHWAYS)), (F.col("k") % 7 + 1).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("width"), F.when(F.col("k") % 5 == 0, "6 m"), F.lit("lanes"), F.when(F.col("k") % 5 == 1, "4")), lambda _, v: v.isNotNull())
    at = [F.expr(f"cast({p} as double)") for p in _POINTS]
    return k.select(F.col("k").alias("way_id"), tags.alias("tags"), F.array(*at[::2]).alias("rows"), F.array(*at[1::2]).alias("cols"))


@query("burn_tagged_ways", with_more("cells", _SEGMENTS, "select way_id, count(*) px, sum(r * 31 + c)::bigint chk from burned group by 1"))
def burn_tagged_ways(spark, d):
    """Polylines burned as capsules as wide as their tags say, and cut to the grid."""
    burned = vectors.burn_capsules(_tagged_ways(spark, d), GSD, index(spark, d).cells)
    return burned.groupBy("way_id").agg(F.count("*").alias("px"), F.sum(F.col("r") * 31 + F.col("c")).alias("chk"))


@query("tagged_way_hist", with_more("cells", _SEGMENTS, "select way_id, class_id, count(*) px from burned join cells using (r, c) where valid group by 1, 2"))
def tagged_way_hist(spark, d):
    """Classes under each burned way."""
    i = index(spark, d)
    return vectors.burn_capsules(_tagged_ways(spark, d), GSD, i.cells).join(i.valid.select("r", "c", "class_id"), ["r", "c"]).groupBy("way_id", "class_id").agg(F.count("*").alias("px"))


@query("way_hist", sql("ways", "select way_id, class_id, count(*) px from way_cells join cells using (r, c) where valid group by 1, 2"))
def way_hist(spark, d):
    i = index(spark, d)
    return i.way_cells.join(i.valid.select("r", "c", "class_id"), ["r", "c"]).groupBy("way_id", "class_id").agg(F.count("*").alias("px"))


ROADS = _in(tx.SERIES["road"])


@query("road_share", sql("ways", f"select way_id, count(*) px, round(count(*) filter (class_id in ({ROADS}))::double / count(*), 6) road, round(count(*) filter (class_id in (0, 2))::double / count(*), 6) hidden from way_cells join cells using (r, c) where valid group by 1"))
def road_share(spark, d):
    i = index(spark, d)
    under = i.way_cells.join(i.valid.select("r", "c", "class_id"), ["r", "c"])
    share = lambda ids: R6(F.count_if(F.col("class_id").isin(ids)) / F.count("*"))
    return under.groupBy("way_id").agg(F.count("*").alias("px"), share(tx.ids(tx.SERIES["road"])).alias("road"), share([0, 2]).alias("hidden"))


def _road_check(name: str, where: str, sev: str):
    @query(name, sql("ways", f"select way_id, round({sev}, 6) severity from (select way_id, count(*) px, count(*) filter (class_id in ({ROADS}))::double / count(*) road, count(*) filter (class_id in (0, 2))::double / count(*) hidden from way_cells join cells using (r, c) where valid group by 1) q where px >= 60 and {where}"))
    def run(spark, d):
        i = index(spark, d)
        under = i.way_cells.join(i.valid.select("r", "c", "class_id"), ["r", "c"]).groupBy("way_id").agg(F.count("*").alias("px"), (F.count_if(F.col("class_id").isin(tx.ids(tx.SERIES["road"]))) / F.count("*")).alias("road"), (F.count_if(F.col("class_id").isin([0, 2])) / F.count("*")).alias("hidden"))
        return under.where(f"px >= 60 and {where}").select("way_id", R6(F.expr(sev)).alias("severity"))


# a mapped road of 60 cells or more with little road under it: hidden by shadow, or missing
_road_check("osm_road_missing", "road < 0.20 and hidden < 0.04", "least(0.85, (1 - road) * 0.75)")
_road_check("osm_road_occluded", "road < 0.20 and hidden >= 0.04", "least(0.85, (1 - road) * hidden * 0.75)")


@query("osm_road_extra", sql("regions ways", f"select region_id, round(coalesce(n, 0)::double / area_px, 6) overlap from rid left join (select region_id, count(*) n from creg join (select distinct r, c from way_cells) w using (r, c) group by 1) q using (region_id) where class_id in ({ROADS}) and coalesce(n, 0)::double / area_px < 0.15"))
def osm_road_extra(spark, d):
    """Labelled road that no mapped road explains."""
    i = index(spark, d)
    n = i.cell_region.join(i.road_cells, ["r", "c"]).groupBy("region_id").agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) / F.col("area_px")
    return i.region_ids.where(F.col("class_id").isin(tx.ids(tx.SERIES["road"]))).join(n, "region_id", "left").where(share < 0.15).select("region_id", R6(share).alias("overlap"))


@query("region_way_overlap", sql("regions ways", "select region_id, way_id, count(*) px, round(count(*)::double / max(area_px), 6) share from creg join way_cells using (r, c) join rid using (region_id) group by 1, 2"))
def region_way_overlap(spark, d):
    i = index(spark, d)
    return i.cell_region.join(i.way_cells, ["r", "c"]).groupBy("region_id", "way_id").agg(F.count("*").alias("px")).join(i.region_ids.select("region_id", "area_px"), "region_id").select("region_id", "way_id", "px", R6(F.col("px") / F.col("area_px")).alias("share"))


@query("dominant_region_of_way", sql("regions ways", "select way_id, arg_max(region_id, n * 1000000 - region_id) region_id from (select way_id, region_id, count(*) n from creg join way_cells using (r, c) group by 1, 2) group by 1"))
def dominant_region_of_way(spark, d):
    """The region with most of a way's cells; a way over no region has no row, rather than a wrong one."""
    i = index(spark, d)
    n = i.cell_region.join(i.way_cells, ["r", "c"]).groupBy("way_id", "region_id").agg(F.count("*").alias("n"))
    return n.groupBy("way_id").agg(F.max_by("region_id", F.col("n") * 1000000 - F.col("region_id")).alias("region_id"))


@query("road_nodes", sql("ways", "select h.way_id a, v.way_id b, h.pos r, v.pos c from ways h join ways v on h.horiz and not v.horiz"))
def road_nodes(spark, d):
    """Crossings of a horizontal and a vertical way: every way is met by the cells it has in common."""
    w = index(spark, d).ways
    h, v = w.where("horiz").select(F.col("way_id").alias("a"), F.col("pos").alias("r")), w.where("not horiz").select(F.col("way_id").alias("b"), F.col("pos").alias("c"))
    cells = index(spark, d).cells.select("r", "c")
    return cells.join(F.broadcast(h), "r").join(F.broadcast(v), "c").select("a", "b", "r", "c")


@query("road_segments", sql("ways", "select way_id, count(*) n_segments, max(len) longest_px from (select way_id, p - lag(p, 1, 0) over (partition by way_id order by p) len from (select h.way_id, v.pos p from ways h join ways v on h.horiz and not v.horiz union select v.way_id, h.pos from ways h join ways v on h.horiz and not v.horiz)) group by 1"))
def road_segments(spark, d):
    """Ways cut at their junctions; the lengths between them."""
    n = road_nodes(spark, d)
    at = n.select(F.col("a").alias("way_id"), F.col("c").alias("at")).unionByName(n.select(F.col("b").alias("way_id"), F.col("r").alias("at"))).distinct()
    cut = at.withColumn("len", F.col("at") - F.lag("at", 1, 0).over(Window.partitionBy("way_id").orderBy("at")))
    return cut.groupBy("way_id").agg(F.count("*").alias("n_segments"), F.max("len").alias("longest_px"))


@query("intersection_degree", sql("ways", "select r, c, count(distinct way_id) degree from way_cells group by 1, 2 having count(distinct way_id) >= 2"))
def intersection_degree(spark, d):
    return index(spark, d).way_cells.groupBy("r", "c").agg(F.count_distinct("way_id").alias("degree")).where("degree >= 2")


@query("blocks", sql("blocks", "select root, count(*) px, min(r) r0, min(c) c0, max(r) r1, max(c) c1 from blk group by 1"))
def blocks(spark, d):
    return index(spark, d).blocks.groupBy("root").agg(F.count("*").alias("px"), F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"))


@query("block_stats", sql("blocks", "select root, class_id, count(*) px from blk join cells using (r, c) group by 1, 2"))
def block_stats(spark, d):
    i = index(spark, d)
    return i.blocks.join(i.cells.select("r", "c", "class_id"), ["r", "c"]).groupBy("root", "class_id").agg(F.count("*").alias("px"))


@query("block_entropy", sql("blocks", "select root, round(abs(-sum(f * log2(f))), 6) entropy from (select root, count(*)::double / sum(count(*)) over (partition by root) f from blk join cells using (r, c) group by root, class_id) group by 1"))
def block_entropy(spark, d):
    b = block_stats(spark, d).withColumn("f", F.col("px") / F.sum("px").over(Window.partitionBy("root")))
    return b.groupBy("root").agg(F.round(F.abs(-F.sum(F.col("f") * F.log2("f"))), 6).alias("entropy"))


@query("block_way_bounds", sql("blocks", "select distinct root, way_id from blk join way_cells w on abs(w.r - blk.r) <= 2 and abs(w.c - blk.c) <= 2"))
def block_way_bounds(spark, d):
    """Ways within two cells of a block: footprints are widened by explosion, so the join is an equality."""
    i = index(spark, d)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-2, 3) for b in range(-2, 3))))
    wide = i.way_cells.select("way_id", "r", "c", steps.alias("s")).select("way_id", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")).distinct()
    return i.blocks.join(wide, ["r", "c"]).select("root", "way_id").distinct()


@query("blocks_of_region", sql("regions blocks", "select region_id, root, px from (select region_id, root, count(*) px, row_number() over (partition by region_id order by count(*) desc, root) k from creg join blk using (r, c) group by 1, 2) where k <= 3"))
def blocks_of_region(spark, d):
    i = index(spark, d)
    n = i.cell_region.join(i.blocks, ["r", "c"]).groupBy("region_id", "root").agg(F.count("*").alias("px"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("px"), "root"))).where("k <= 3").select("region_id", "root", "px")


@query("blocks_in_window", sql("blocks", "select root, count(*) filter (r between 40 and 79 and c between 40 and 119) px, round(count(*) filter (r between 40 and 79 and c between 40 and 119)::double / count(*), 6) share_of_block, round(count(*) filter (r between 40 and 79 and c between 40 and 119)::double / 3200, 6) share_of_window from blk group by 1 having count(*) filter (r between 40 and 79 and c between 40 and 119) >= 32"))
def blocks_in_window(spark, d):
    inside = F.expr("r between 40 and 79 and c between 40 and 119")
    return index(spark, d).blocks.groupBy("root").agg(F.count_if(inside).alias("px"), R6(F.count_if(inside) / F.count("*")).alias("share_of_block"), R6(F.count_if(inside) / 3200).alias("share_of_window")).where("px >= 32")


@query("partition_degenerate", sql("ways blocks", "select round(road / n, 6) road_share, round(top / free, 6) dominance, road / n < 0.005 or top / free > 0.90 degenerate from (select (select count(*) from (select distinct r, c from way_cells))::double road, (select count(*) from cells)::double n, (select max(k) from (select count(*) k from blk group by root))::double top, (select count(*) from blk)::double free) q"))
def partition_degenerate(spark, d):
    """Whether streets partition this ground at all."""
    i = index(spark, d)
    sizes = i.blocks.groupBy("root").agg(F.count("*").alias("k")).agg(F.max("k").alias("top"), F.sum("k").alias("free"))
    row = i.road_cells.agg(F.count("*").alias("road")).join(i.cells.agg(F.count("*").alias("n"))).join(sizes)
    a, b = F.col("road") / F.col("n"), F.col("top") / F.col("free")
    return row.select(R6(a).alias("road_share"), R6(b).alias("dominance"), ((a < 0.005) | (b > 0.90)).alias("degenerate"))


OVER = "(select s.r, s.c, s.class_id, case when w.r is not null then greatest(s.s, 0.9 * greatest(0, least(1, 1 - (slope - 5) / 20.0))) else s.s end after, s.s before from (select r, c, class_id, slope, case when traffic < 0.45 then 0 else traffic * greatest(0, least(1, 1 - (slope - 5) / 20.0)) end s from sl join dim using (class_id) where valid) s left join (select distinct r, c from way_cells) w on w.r = s.r and w.c = s.c)"


def _overlay(i):
    base = products.trafficability(i, "wheeled").where("valid").join(i.slope.select("r", "c", "slope"), ["r", "c"]).join(i.road_cells.withColumn("road", F.lit(True)), ["r", "c"], "left")
    term = products.clip01(1 - (F.col("slope") - products.SLOPE_FREE) / 20.0)
    return base.select("r", "c", "class_id", F.col("score").alias("before"), F.when(F.col("road"), F.greatest("score", 0.9 * term)).otherwise(F.col("score")).alias("after"))


@query("traffic_overlay", sql("slope dim ways", f"select class_id, round(sum(after), 5) total from {OVER} o group by 1"))
def traffic_overlay(spark, d):
    """Mapped roads over the labels: the better of the two, slope still counting."""
    return _overlay(index(spark, d)).groupBy("class_id").agg(F.round(F.sum("after"), 5).alias("total"))


@query("osm_delta", sql("slope dim ways", f"select round(count(*) filter (abs(after - before) > 1e-9)::double / count(*), 6) moved, round(avg(before), 6) before, round(avg(after), 6) after from {OVER} o"))
def osm_delta(spark, d):
    return _overlay(index(spark, d)).agg(R6(F.count_if(F.abs(F.col("after") - F.col("before")) > 1e-9) / F.count("*")).alias("moved"), R6(F.avg("before")).alias("before"), R6(F.avg("after")).alias("after"))


@query("align_shift", sql("ways", "select dr, dc, count(*) px from (select distinct r, c from way_cells) w cross join (select unnest(generate_series(-12, 12)) dr) a cross join (select unnest(generate_series(-12, 12)) dc) b join cells x on x.r = w.r + dr and x.c = w.c + dc where valid and class_id in (8, 9, 10) group by 1, 2"))
def align_shift(spark, d):
    """How much road the mapped ways cover at each shift of up to 6 m each way; the best one says how far they are off."""
    i = index(spark, d)
    return reference_map.shift_counts(i.road_cells, i.valid.where(F.col("class_id").isin(8, 9, 10)), GSD)


GRADE = "case when way_id % 4 = 0 then 'primary' when way_id % 4 = 1 then 'residential' else 'track' end"


@query("street_rollup", sql("ways", f"select grade, count(distinct way_id) n_ways, count(*) px, string_agg(distinct surface, ',' order by surface) surfaces from (select way_id, {GRADE} grade, case when way_id % 3 = 0 then 'asphalt' else 'gravel' end surface from way_cells) q group by 1"))
def street_rollup(spark, d):
    tagged = index(spark, d).way_cells.select("way_id", F.expr(GRADE).alias("grade"), F.expr("case when way_id % 3 = 0 then 'asphalt' else 'gravel' end").alias("surface"))
    return tagged.groupBy("grade").agg(F.count_distinct("way_id").alias("n_ways"), F.count("*").alias("px"), F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


@query("layer_area", sql("ways", "select half, count(*) * 0.25::double area_m2 from (select distinct half, r, c from way_cells join ways using (way_id)) group by 1"))
def layer_area(spark, d):
    i = index(spark, d)
    return i.way_cells.join(F.broadcast(i.ways.select("way_id", "half")), "way_id").select("half", "r", "c").distinct().groupBy("half").agg((F.count("*") * PIXEL_M2).cast("double").alias("area_m2"))



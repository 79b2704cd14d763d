"""Notes, legends, tags, providers, tools and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import taxonomy as tx
from ..plans import providers, verbs
from ..plans.index import index
from ..streaming import snapshots
from .duck import sql


@query("legend", sql("dim", "select class_id, name, superclass, coalesce(lithology || '/' || morphology, '') rock from dim"))
def legend(spark, d):
    return tx.dim_class(spark).select("class_id", "name", "superclass", F.coalesce(F.concat_ws("/", F.col("lithology"), F.when(F.col("lithology").isNotNull(), F.col("morphology"))), F.lit("")).alias("rock"))


@query("switch_target", "select 'House' target")
def switch_target(spark, d):
    return spark.sql("select split('SWITCH:House', ':')[1] as target")


@query("traversability", sql("slope dim", "select class_id, count(*) n, round(avg(case when valid then case when traffic < 0.45 then 0 else traffic * greatest(0, least(1, 1 - (slope - 5) / 20.0)) end end), 5) mean, round(count(*) filter (not valid)::double / count(*), 6) unmeasured from sl join dim using (class_id) group by 1"))
def traversability(spark, d):
    """The built-in provider: null, not 0, where nothing was measured."""
    s = providers.estimate("builtin", index(spark, d), vehicle="wheeled")
    return s.groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.avg(F.col("score").isNull().cast("int")), 6).alias("unmeasured"))


@query("mask_union", sql("cells", "select r, c from cells where class_id = 4 union select r, c from cells where class_id2 = 4"))
def mask_union(spark, d):
    c = index(spark, d).cells
    return c.where("class_id = 4").select("r", "c").union(c.where("class_id2 = 4").select("r", "c")).distinct()


@query("mask_intersect", sql("cells", "select r, c from cells where class_id = 4 intersect select r, c from cells where class_id2 = 4"))
def mask_intersect(spark, d):
    c = index(spark, d).cells
    return c.where("class_id = 4").select("r", "c").intersect(c.where("class_id2 = 4").select("r", "c"))


@query("mask_difference", sql("cells", "select r, c from cells where class_id = 4 except select r, c from cells where class_id2 = 4"))
def mask_difference(spark, d):
    c = index(spark, d).cells
    return c.where("class_id = 4").select("r", "c").join(c.where("class_id2 = 4").select("r", "c"), ["r", "c"], "left_anti")


@query("hist_union_keys", sql("cells", "select coalesce(x.k, y.k) class_id, coalesce(x.n, 0) first_px, coalesce(y.n, 0) second_px from (select class_id k, count(*) n from cells where valid group by 1) x full join (select class_id2 k, count(*) n from cells where valid2 group by 1) y on x.k = y.k"))
def hist_union_keys(spark, d):
    c = index(spark, d).cells
    a = c.where("valid").groupBy("class_id").agg(F.count("*").alias("first_px"))
    b = c.where("valid2").groupBy(F.col("class_id2").alias("class_id")).agg(F.count("*").alias("second_px"))
    return a.join(b, "class_id", "full_outer").select("class_id", F.coalesce("first_px", F.lit(0)).cast("long").alias("first_px"), F.coalesce("second_px", F.lit(0)).cast("long").alias("second_px"))


@query("topk_per_group", sql("chips", "select chip_r, chip_c, class_id, k from (select *, row_number() over (partition by chip_r, chip_c order by px desc, class_id) k from chip_class) where k <= 3"))
def topk_per_group(spark, d):
    k = F.row_number().over(Window.partitionBy("chip_r", "chip_c").orderBy(F.desc("px"), "class_id"))
    return index(spark, d).chip_class.withColumn("k", k.cast("long")).where("k <= 3").select("chip_r", "chip_c", "class_id", "k")


@query("dedupe_first", sql("nh", "select region_id, nbr_class from (select region_id, nbr_class, row_number() over (partition by region_id order by shared_px desc, nbr_class) k from nh) where k = 1 order by region_id limit 50"))
def dedupe_first(spark, d):
    k = F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("shared_px"), "nbr_class"))
    return index(spark, d).neighbour_hist.withColumn("k", k).where("k = 1").orderBy("region_id").limit(50).select("region_id", "nbr_class")


@query("select_budget", "select n, greatest(1, round_even(n * 0.2, 0))::bigint k from (select unnest([1, 2, 3, 12, 13, 25, 28, 120]) n)")
def select_budget(spark, d):
    """Half-even rounding: 12.5 units are 12, 2.5 are 2."""
    return spark.sql("select n, cast(greatest(1, bround(n * 0.2D)) as bigint) as k from (select explode(array(1, 2, 3, 12, 13, 25, 28, 120)) as n)")


@query("tool_definitions")
def tool_definitions(spark, d):
    rows = [(t["name"], len(t["input_schema"]["properties"])) for t in verbs.tool_definitions()]
    return spark.sql("select * from values " + ", ".join(f"('{n}', {k})" for n, k in rows) + " as t(name, n_args)")


@query("events_tumbling", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def events_tumbling(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return snapshots.tumbling(e).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("events_sessions", "select user_id, s as start, max(ts) + interval '30 minutes' as \"end\", count(*) n from (select *, min(ts) over (partition by user_id, g) s from (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) g from (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end new from events))) group by user_id, s")
def events_sessions(spark, d):
    return snapshots.sessions(spark.read.parquet(f"{d}/events.parquet"))


@query("asof_events", "select e.event_id, max(p.event_id) previous from events e left join events p on p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts < e.ts) and not exists (select 1 from events q where q.user_id = e.user_id and q.event_type = 'purchase' and q.ts < e.ts and q.ts > p.ts) group by 1")
def asof_events(spark, d):
    """The latest purchase of the same user before each event: one window, no range join."""
    e = spark.read.parquet(f"{d}/events.parquet")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    by_ts = e.groupBy("user_id", "ts").agg(F.max(bought).alias("b"))
    last = F.last("b", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    return e.join(by_ts.withColumn("p", last), ["user_id", "ts"]).select("event_id", F.col("p.event_id").alias("previous"))

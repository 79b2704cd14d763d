"""The fact table: one row a cell.  Derived here from the star-schema test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres a cell side; its area is exact in binary.
GSD, PIXEL_M2 = 0.5, 0.25
#: Cells a row of the derived grid, and the multiplier that makes (row, column) one number.
WIDTH, STRIDE = 200, 1000


def derived_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, class_id, valid, class_id2, valid2, elev): 4 x 4 patches of part, noise of lineitem."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("pk"), F.expr("cast(p_size % 47 as int)").alias("cls"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    height = part.agg(F.expr("cast(floor(max(pk) / 50) as bigint) * 4 + 4").alias("h"))

    def noise(flag: str, number: int, times: int, name: str) -> DataFrame:
        picked = line.where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == number)).join(F.broadcast(height))
        return picked.groupBy(F.expr("l_partkey % h").alias("r"), F.expr("l_orderkey % 200").alias("c")).agg(F.min(F.expr(f"l_suppkey * {times} % 47")).cast("int").alias(name))

    four = F.array(*map(F.lit, range(4)))
    base = part.withColumn("i", F.explode(four)).withColumn("j", F.explode(four)).select(F.expr("cast(floor(pk / 50) as bigint) * 4 + i").alias("r"), F.expr("pk % 50 * 4 + j").alias("c"), "pk", "cls")
    both = base.join(noise("R", 1, 1, "n1"), ["r", "c"], "left").join(noise("A", 2, 7, "n2"), ["r", "c"], "left")
    first = F.coalesce("n1", "cls")
    return both.select(
        F.col("r").cast("long"),
        F.col("c").cast("long"),
        first.alias("class_id"),
        (F.col("pk") % 29 != 0).alias("valid"),
        F.coalesce("n2", F.when(first == 5, F.lit(26)).otherwise(first)).cast("int").alias("class_id2"),
        (F.col("pk") % 31 != 0).alias("valid2"),
        (F.col("r") * 0.25 + F.col("pk") % 7 * 0.5).cast("double").alias("elev"),
    )


#: The same grid for DuckDB, as the start of a WITH clause.
DUCK_CELLS = """
patch as (select p_partkey pk, (p_size % 47)::int cls from part),
hdim as (select floor(max(pk) / 50)::bigint * 4 + 4 h from patch),
base as (select floor(pk / 50)::bigint * 4 + i r, (pk % 50) * 4 + j c, pk, cls from patch cross join (select unnest([0, 1, 2, 3]) i) a cross join (select unnest([0, 1, 2, 3]) j) b),
n1 as (select l_partkey % h r, l_orderkey % 200 c, min(l_suppkey % 47) cls from lineitem cross join hdim where l_returnflag = 'R' and l_linenumber = 1 group by 1, 2),
n2 as (select l_partkey % h r, l_orderkey % 200 c, min((l_suppkey * 7) % 47) cls from lineitem cross join hdim where l_returnflag = 'A' and l_linenumber = 2 group by 1, 2),
cells as (select base.r::bigint r, base.c::bigint c, coalesce(n1.cls, base.cls)::int class_id, (pk % 29) <> 0 as valid,
  coalesce(n2.cls, case when coalesce(n1.cls, base.cls) = 5 then 26 else coalesce(n1.cls, base.cls) end)::int class_id2, (pk % 31) <> 0 as valid2,
  base.r::double * 0.25 + (pk % 7)::double * 0.5 elev
  from base left join n1 on base.r = n1.r and base.c = n1.c left join n2 on base.r = n2.r and base.c = n2.c)"""


def derived_ways(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """(way_id, horiz, pos, half): one axis-parallel way a nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    high = cells.agg((F.max("r") + 1).alias("h"))
    return nation.join(F.broadcast(high)).select(
        F.col("k").alias("way_id"),
        (F.col("k") % 2 == 0).alias("horiz"),
        F.when(F.col("k") % 2 == 0, (F.col("k") * 29 + 11) % F.col("h")).otherwise((F.col("k") * 37 + 5) % WIDTH).cast("long").alias("pos"),
        F.when(F.col("k") % 3 == 0, 1).otherwise(0).cast("long").alias("half"),
    )


DUCK_WAYS = """
ways as (select n_nationkey::bigint way_id, n_nationkey % 2 = 0 as horiz,
  (case when n_nationkey % 2 = 0 then (n_nationkey * 29 + 11) % h else (n_nationkey * 37 + 5) % 200 end)::bigint pos, (case when n_nationkey % 3 = 0 then 1 else 0 end)::bigint half
  from nation cross join (select max(r) + 1 h from cells) x),
way_cells as (select way_id, r, c from ways join cells on (horiz and r between pos - half and pos + half) or (not horiz and c between pos - half and pos + half))"""

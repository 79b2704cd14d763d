"""Connected components of an edge table, by alternating large and small stars.

Every round replaces neighbours by the least neighbour, first among larger, then among smaller
ids; it ends when nothing changes.  Minima are pre-aggregated before the shuffle and joined back,
so a node with very many edges is split like any skewed join key.  Each round is written to the
shared scratch folder, which cuts lineage and survives a lost executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go when the session names no shared folder (tests, laptops).
LOCAL_SCRATCH = "/tmp/checkpoints/geoloom"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that every executor sees; only a session without one gets a local path."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SCRATCH).rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to a table of its own in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/geoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another.

    edges may be in any direction, repeated or loops; null ends are left out.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = staged(pair.distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

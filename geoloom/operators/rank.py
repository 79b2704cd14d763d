"""Dense numbering of a whole table in a total order, without ever sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name = 1..n in the order of columns that together are unique.

    Ranges of the order are numbered apart, and offset by the (few) ranges' sizes.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(before), "_p").withColumn(name, (own + F.col("_before")).cast("long")).drop("_p", "_before")

"""Dense row numbers for tables without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MASK = (1 << 33) - 1


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds the position of each row, from 0, in the order of partitions and of rows within them.

    A first pass counts the rows of each partition, so both passes must give the same rows in the same partitions, as a
    scan of files does.
    """
    tagged = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    start = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("c")).select("__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    return tagged.join(start, "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_MASK))).drop("__part", "__at", "__start")

"""Running sums and ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.session import written


def cumulated(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df, written, with the sum of value over the rows before each in that order (of equal rows in any order).

    Rows are dealt into ranges of the order; sums run inside each range, and the sums of whole ranges, as many as partitions, are added to them."""
    x = written(df.withColumn("__value", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = {r["__range"]: r["n"] for r in x.groupBy("__range").agg(F.sum("__value").alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(sums):
        starts.append((k, total))
        total += sums[k] or 0
    before = x.sparkSession.createDataFrame(starts, "__range int, __start long")
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__value", "__start")

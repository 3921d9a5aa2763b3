"""Places of all rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, the place of each (from 1) among the rows of its group, as row_number() gives it; order tells all rows of a group apart.

    A window has a whole group in one task. Here rows are dealt by ranges of group and order, and a row's place is the one in
    its range after all rows that the ranges before it have of its group. The ranges are written, so that they are the same
    when they are counted and when they are read; what is counted is a row for each range and group in it.
    """
    keys = [F.col(group).asc(), *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")))
    each = ordered.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_start"))
    found = ordered.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return found.withColumn(name, (F.col("_at") + F.col("_start")).cast("int")).drop("_at", "_range", "_group", "_of", "_start")

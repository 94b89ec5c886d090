"""Whole tables in a stated order, with each row's place, without putting a table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has a row's place in its partition here


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows in order, nulls first, with their place from 1; order should tell rows apart.

    Rows are dealt by ranges; the numbers of rows of the ranges before, one row a range, give a range its start.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "starts")
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_range", "_start", "_at")

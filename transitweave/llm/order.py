"""Places of rows in a global order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has a row's place in its partition here


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with idx, the place in its group by `order` from 0, and n, the rows of its group.

    Rows are dealt by ranges of group and order, so a large group spreads over
    tasks; order should tell rows apart, or equal ones share a range. Of each range and group
    only its number of rows is summed up: as many rows as there are ranges and
    groups, which Spark broadcasts if the written table is small and shuffles if not.
    Places are written, so a task that runs again can't change them.
    """
    spark = rows.sparkSession
    by = [*group, *order]
    ranged = written(rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), f"{name}-places")
    stays = ranged.groupBy("range", *group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(stays.select("range", *group, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(*group)).alias("n")), f"{name}-starts")
    return ranged.join(starts, ["range", *group]).withColumn("idx", F.col("place") + F.col("shift")).drop("range", "place", "shift")

"""Samples as a stored table that is merged into: dates without a change keep their files, rows without a change their updated_at."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from ..operators.keep import kept, remove
from .observations import changed_samples

_LOG = "version long, day string"
_DAY = "service_date"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """day, version: which version wrote each date last."""
    try:
        lines = spark.read.schema(_LOG).parquet(f"{folder}/log/*")
    except AnalysisException:
        return spark.createDataFrame([], "day string, version long")
    return lines.groupBy("day").agg(F.max("version").alias("version"))


def _table(spark: SparkSession, folder: str, days: DataFrame, schema: StructType) -> DataFrame:
    """Rows of days (day, version)."""
    paths = [f"{folder}/version={r.version}/day={r.day}" for r in days.collect()]  # a row a date
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it is after the last merge that ended, with updated_at."""
    days = _log(spark, folder)
    first = days.first()
    if first is None:
        raise ValueError(f"{folder} holds no samples")
    return _table(spark, folder, days, spark.read.parquet(f"{folder}/version={first.version}/day={first.day}").schema)


def merge_samples(new: DataFrame, folder: str, at: str) -> int:
    """Merges new samples into folder; returns how many rows are new or different.

    new: one row for each trip, date and window. Only dates with such a row are written anew, and only
    these rows get updated_at `at`, a timestamp; so the same samples again change nothing. The log
    comes last: a merge that breaks off leaves the table as it was, and one that runs again writes the same.
    """
    spark = new.sparkSession
    log = kept(_log(spark, folder), "log")
    new = kept(new.withColumn("day", F.col(_DAY).cast("string")), "new-samples")
    touched = log.join(new.select("day").distinct(), "day", "left_semi")
    schema = StructType([*new.drop("day").schema.fields, StructField("updated_at", TimestampType())])
    old = _table(spark, folder, touched, schema)
    both = changed_samples(new.drop("day"), old.drop("updated_at"))
    both = both.join(old.select("trip_id", _DAY, "time_window", "updated_at"), ["trip_id", _DAY, "time_window"], "left")
    both = kept(both.withColumn("updated_at", F.when(F.col("changed"), F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))).withColumn("day", F.col(_DAY).cast("string")), "merged-samples")
    days = kept(both.where("changed").groupBy("day").agg(F.count(F.lit(1)).alias("n")), "changed-days")
    changed = days.agg(F.sum("n")).first()[0] or 0
    if changed:
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        rows = both.join(days.select("day"), "day", "left_semi").select(*schema.names, "day")
        rows.repartition("day", F.pmod(F.xxhash64("trip_id"), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/version={version}")
        days.select(F.lit(version).cast("long").alias("version"), "day").coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/{version}")
    return changed


def compact(spark: SparkSession, folder: str) -> int:
    """Deletes the files of dates that later versions have written again, while no merge runs; returns how many dates of versions that were.

    A log of what counts is written first, then the old log and the files go: whatever breaks off, what counts stays readable.
    """
    log = kept(_log(spark, folder), "log")
    if log.isEmpty():
        return 0
    lines = spark.read.schema(_LOG).parquet(f"{folder}/log/*")
    stale = [f"{folder}/version={r.version}/day={r.day}" for r in lines.join(log, ["day", "version"], "left_anti").distinct().collect()]  # a row a date and version
    old = sorted({f.rpartition("/")[0] for f in lines.inputFiles()})
    log.select("version", "day").coalesce(1).write.parquet(f"{folder}/log/whole-{uuid.uuid4().hex}")
    remove(spark, old + stale)
    return len(stale)

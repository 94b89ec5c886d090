"""Delay observations as a stream: raw polls without repeats, the newest of each stop visit, counts by time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.keep import kept, remove
from ..operators.reliability import KEYS, latest, samples


def unrepeated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops polls seen already; state is kept as long as an event may be late."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark([*KEYS, "observed_at"])


_DAY = "service_date"


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    """date, batch: which batch wrote the table of each date last."""
    try:
        lines = spark.read.schema("batch long, day date").parquet(f"{folder}/log/*")
    except AnalysisException:
        return spark.createDataFrame([], "day date, batch long")
    return lines.groupBy("day").agg(F.max("batch").alias("batch"))


def _read(spark: SparkSession, folder: str, where: DataFrame, schema: StructType) -> DataFrame:
    """The rows of the dates in `where`, each from the batch that wrote it last."""
    paths = [f"{folder}/batch={r.batch}/day={r.day}" for r in where.collect()]  # a row a date
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest_batch(folder: str, partitions: int):
    """For foreachBatch: folds a batch into the table of the newest observations.

    Only the dates that a batch touches are written anew, each into a folder of
    the batch; its line in the log, which comes last, makes them count. A batch that
    runs again after a failure reads what batches before it wrote, and writes the same.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch).persist()
        touched = rows.select(F.col(_DAY).alias("day")).distinct().where("day IS NOT NULL")
        before = _tables(spark, folder).where(F.col("batch") < number).join(touched, "day", "left_semi")
        old = _read(spark, folder, before, rows.schema)
        both = latest(rows.unionByName(old)).withColumn("day", F.col(_DAY))
        both.repartition(partitions, *KEYS).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={number}")
        touched.select(F.lit(number).cast("long").alias("batch"), "day").coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/{number}")
        rows.unpersist()

    return fold


def keep_newest(stream: DataFrame, folder: str, checkpoint: str, partitions: int = 8) -> StreamingQuery:
    """Starts a query that keeps, under folder, the newest observation of each stop visit, however late it comes."""
    return stream.writeStream.foreachBatch(_newest_batch(folder, partitions)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The table after the last batch that has ended; nothing else than its log tells which that is."""
    where = _tables(spark, folder)
    first = where.first()
    if first is None:
        raise ValueError(f"{folder} holds no observations")
    schema = spark.read.parquet(f"{folder}/batch={first.batch}/day={first.day}").schema
    return _read(spark, folder, where, schema)


def compact(spark: SparkSession, folder: str) -> int:
    """Deletes what later batches have written again, and puts the log into one file, while no stream writes; returns how many dates of batches that were.

    The new log comes first, so whatever breaks off, what counts stays readable.
    """
    log = kept(_tables(spark, folder), "log")
    if log.isEmpty():
        return 0
    lines = spark.read.schema("batch long, day date").parquet(f"{folder}/log/*")
    stale = [f"{folder}/batch={r.batch}/day={r.day}" for r in lines.join(log, ["day", "batch"], "left_anti").distinct().collect()]  # a row a date and batch
    old = sorted({f.rpartition("/")[0] for f in lines.inputFiles()})
    log.select("batch", "day").coalesce(1).write.parquet(f"{folder}/log/whole-{uuid.uuid4().hex}")
    remove(spark, old + stale)
    return len(stale)


def changed_samples(new: DataFrame, old: DataFrame) -> DataFrame:
    """Samples after an upsert: rows of new and old by trip, date and window, with `changed` where new differs from old or has no old one."""
    keys = ["trip_id", "service_date", "time_window"]
    values = [c for c in new.columns if c not in keys]
    n, o = new.select(*keys, F.struct(*values).alias("n")), old.select(*keys, F.struct(*values).alias("o"))
    both = n.join(o, keys, "full")
    return both.select(*keys, F.coalesce("n", "o").alias("v"), (F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("o"))).alias("changed")).select(*keys, "v.*", "changed")


def rebuilt(observations: DataFrame, trips: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Samples with `changed`: all of them anew, or with old ones, those of the trips and dates that observations hold, put into the old."""
    new = samples(observations, trips)
    return new.withColumn("changed", F.lit(True)) if old is None else changed_samples(new, old)


def counted(updates: DataFrame, name: str = "feed") -> DataFrame:
    """updates (as of realtime.stop_updates) that report, while they run, how many there were and how many name no stop."""
    lost = F.col("asked_stop").isNull() & F.col("asked_sequence").isNull()
    return updates.observe(name, F.count(F.lit(1)).alias("stop_updates"), F.count_if(lost).alias("malformed"))


def class_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Observations by event-time window and trip, as windows close."""
    rows = stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "trip_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("delay_seconds").alias("mean"))

"""Intermediate results that are used several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}
_KEPT: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate results; a temporary one in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="transitweave-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df, computed once: written to the folder for it, which cuts the plan and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """As kept(), dealt by columns as shuffles deal rows: joins on just these columns don't move its rows again, however often it is joined."""
    spark = df.sparkSession
    app, parts = spark.sparkContext.applicationId, int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = f"{name}_{uuid.uuid4().hex}"
    path, table = f"{folder(spark)}/{own}", f"spark_catalog.default.{own}"
    _KEPT.setdefault(app, []).append(path)
    _TABLES.setdefault(app, []).append(table)
    df.repartition(parts, *columns).write.format("parquet").bucketBy(parts, *columns).sortBy(*columns).option("path", path).saveAsTable(table)
    return spark.table(table)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files or folders of any store that Spark writes to; what isn't there is passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def remove_kept(spark: SparkSession) -> int:
    """Deletes what kept() and kept_by() have written in this application, once the results made from it have been used; returns how many tables."""
    app = spark.sparkContext.applicationId
    for table in _TABLES.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _KEPT.pop(app, [])
    remove(spark, paths)
    return len(paths)

"""Rows of a feed that can't be used, with reasons: orphans cascade from parents to children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feed
from .keep import kept as kept_once

# Child table, its column, the parent table and its key; ? may be blank. In the order of checks.
RULES = [
    ("routes", "agency_id", "agency", "agency_id"),
    ("calendar_dates", "service_id", "calendar", "service_id"),
    ("stops", "parent_station?", "stops", "stop_id"),
    ("trips", "route_id", "routes", "route_id"),
    ("trips", "service_id", "calendar", "service_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("transfers", "from_stop_id", "stops", "stop_id"),
    ("transfers", "to_stop_id", "stops", "stop_id"),
    ("transfers", "from_trip_id?", "trips", "trip_id"),
    ("transfers", "to_trip_id?", "trips", "trip_id"),
    ("route_names_exceptions", "route_id", "routes", "route_id"),
    ("directions", "route_id", "routes", "route_id"),
    ("stop_order_exceptions", "stop_id", "stops", "stop_id"),
]


def with_orphans(rows: DataFrame, column: str, parents: DataFrame, key: str, optional: bool = False) -> DataFrame:
    """Sets the reason of rows that have none yet and whose column is no key of parents.

    One left join on distinct keys; Spark picks a broadcast if these are few.
    """
    known = parents.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, rows[column] == known["_key"], "left")
    lost = F.col("_known").isNull() if not optional else F.col("_known").isNull() & F.col(column).isNotNull()
    return joined.withColumn("reason", F.coalesce("reason", F.when(lost, f"orphan {column}"))).select(*rows.columns)


def judged(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, str]] = RULES) -> dict[str, DataFrame]:
    """Tables with their reasons completed. Tables come with parents before children.

    A removed parent makes orphans of its children. Where a table is its own
    parent, keys of all rows of valid shape count, so a removed stop's children stay.
    """
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        shaped = df.where("reason IS NULL")
        for child, column, parent, key in rules:
            if child == name:
                df = with_orphans(df, column.rstrip("?"), shaped if parent == name else out[parent].where("reason IS NULL"), key, column.endswith("?"))
        out[name] = df
    return out


def kept(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.where("reason IS NULL").drop("reason") for name, df in tables.items()}


def reason_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, reason (null for kept rows), n."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "reason", "n")
        out = part if out is None else out.unionByName(part)
    return out


def cleaned_feed(spark: SparkSession, folder: str, target: str, dry_run: bool = False) -> DataFrame:
    """table, reason, n of a folder of text tables; with rows to remove, and unless dry_run, a cleaned version under target.

    The reason of a row with too few or too many values has its number in the file.
    """
    tables = judged(feed.read_feed(spark, folder))
    counts = kept_once(reason_counts(tables))
    if not dry_run and not counts.where("reason IS NOT NULL").isEmpty():
        feed.write_feed(kept(tables), target, replace=True)
    return counts

"""Which services run when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_services(calendar: DataFrame, exceptions: DataFrame, date: str) -> DataFrame:
    """Services that run on a date: by weekday unless removed, and those added."""
    d = F.to_date(F.lit(date))
    today = exceptions.where(F.col("service_date") == d)
    weekly = calendar.where(d.between(F.col("start_date"), F.col("end_date")) & (F.expr(f"substring(days, weekday(DATE'{date}') + 1, 1)") == "1"))
    weekly = weekly.join(today.where("exception_type = 2"), "service_id", "left_anti").select("service_id")
    return weekly.unionByName(today.where("exception_type = 1").select("service_id")).distinct()


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id, service_date of every day that a service runs."""
    days = calendar.select("service_id", "days", F.explode(F.sequence("start_date", "end_date")).alias("service_date")).where("substring(days, weekday(service_date) + 1, 1) = '1'")
    keys = ["service_id", "service_date"]
    kept = days.join(exceptions.where("exception_type = 2"), keys, "left_anti").select(*keys)
    return kept.unionByName(exceptions.where("exception_type = 1").select(*keys)).distinct()


def operates(pairs: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """pairs (service_id, service_date) with `operates`: an exception decides, else range and weekday; without a rule, no."""
    ruled = pairs.join(exceptions, ["service_id", "service_date"], "left").join(calendar, "service_id", "left")
    weekly = F.col("service_date").between(F.col("start_date"), F.col("end_date")) & F.expr("substring(days, weekday(service_date) + 1, 1) = '1'")
    runs = F.when(F.col("exception_type") == 1, True).when(F.col("exception_type") == 2, False).otherwise(F.coalesce(weekly, F.lit(False)))
    return ruled.select("service_id", "service_date", runs.alias("operates"))


def active_or_unruled(services: DataFrame, calendar: DataFrame, exceptions: DataFrame, date: str) -> DataFrame:
    """Services that run on a date, where one without a calendar row always does."""
    services = services.select("service_id").distinct()  # first, as a service may have any number of trips
    unruled = services.join(calendar, "service_id", "left_anti")
    return active_services(calendar, exceptions, date).join(services, "service_id", "left_semi").unionByName(unruled).distinct()


def next_dates(services: DataFrame, calendar: DataFrame, exceptions: DataFrame, after: str) -> DataFrame:
    """service_id, next_date: the first day after a date on which a service runs, up to its last day; its first day doesn't count."""
    later = calendar.join(services.select("service_id").distinct(), "service_id", "left_semi").withColumn("from", F.date_add(F.to_date(F.lit(after)), 1)).where(F.col("from") <= F.col("end_date"))
    days = later.select("service_id", "days", F.explode(F.sequence("from", "end_date")).alias("service_date")).join(exceptions, ["service_id", "service_date"], "left")
    runs = "exception_type = 1 OR (coalesce(exception_type, 0) <> 2 AND substring(days, weekday(service_date) + 1, 1) = '1')"
    return days.where(runs).groupBy("service_id").agg(F.min("service_date").alias("next_date"))


def expiry(calendar: DataFrame, today: str, warn_days: int = 30) -> DataFrame:
    """One row: last_date, expired, and a warning from warn_days before the last day on."""
    last = calendar.agg(F.max("end_date").alias("last_date"))
    left = F.datediff("last_date", F.to_date(F.lit(today)))
    warning = F.when(left.between(0, warn_days), F.concat(F.lit("expires on "), F.col("last_date").cast("string")))
    return last.select("last_date", (left < 0).alias("expired"), warning.alias("warning"))

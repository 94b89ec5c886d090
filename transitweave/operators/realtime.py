"""Delays out of realtime trip updates, given as nested rows (header, entity[])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EVENT = "struct<delay:int,time:bigint>"
FEED = (
    "header struct<timestamp:bigint>, entity array<struct<id:string,trip_update:struct<trip:struct<trip_id:string,start_date:string>,"
    f"stop_time_update:array<struct<stop_id:string,stop_sequence:int,arrival:{_EVENT},departure:{_EVENT}>>>>>"
)


def event_delay(event: Column, scheduled: Column, date: Column, zone: str) -> Column:
    """The event's own delay; else its time less the scheduled one, counted from midnight of the service date by the wall clock."""
    midnight = F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.lit(0), F.lit(0), F.lit(0))
    clock = midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), scheduled.cast("decimal(18,6)"))
    since = F.convert_timezone(F.lit(zone), F.lit("UTC"), clock) - F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    part = lambda name: F.extract(F.lit(name), since).cast("long")  # noqa: E731  the session's zone plays no part
    planned = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    return F.coalesce(event["delay"].cast("long"), event["time"] - planned)


def trip_updates(feeds: DataFrame) -> DataFrame:
    """observed_at, trip_id, service_date and updates of each trip update; service_date is null if malformed."""
    rows = feeds.select(F.timestamp_seconds(F.coalesce("header.timestamp", F.lit(0))).alias("observed_at"), F.explode("entity").alias("e")).where("e.trip_update IS NOT NULL")
    trip, date = F.nullif(F.trim("e.trip_update.trip.trip_id"), F.lit("")), F.trim("e.trip_update.trip.start_date")
    good = F.when(trip.isNotNull() & date.rlike(r"^\d{8}$"), F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date"))
    return rows.select("observed_at", trip.alias("trip_id"), good.alias("service_date"), F.col("e.trip_update.stop_time_update").alias("updates"))


def stop_updates(feeds: DataFrame) -> DataFrame:
    """One row per stop update of a sound trip update, with update_id to tell them apart."""
    rows = trip_updates(feeds).where("service_date IS NOT NULL").select("observed_at", "trip_id", "service_date", F.posexplode("updates").alias("position", "u"))
    return rows.select("observed_at", "trip_id", "service_date", "position", F.nullif(F.trim("u.stop_id"), F.lit("")).alias("asked_stop"), F.col("u.stop_sequence").alias("asked_sequence"), F.col("u.arrival").alias("arrival"), F.col("u.departure").alias("departure"))


def matched(updates: DataFrame, schedule: DataFrame) -> DataFrame:
    """Updates with the first stop of their trip that fits stop and sequence, where given; scheduled is null if none does.

    schedule: trip_id, stop_id, stop_sequence, arrival_seconds, departure_seconds.
    """
    s = schedule.where("coalesce(arrival_seconds, departure_seconds) IS NOT NULL").select("trip_id", F.struct(F.col("stop_sequence"), F.col("stop_id"), F.coalesce("arrival_seconds", "departure_seconds").alias("arrival"), F.col("departure_seconds").alias("departure")).alias("s"))
    keys = ["observed_at", "trip_id", "service_date", "position", "asked_stop", "asked_sequence"]
    asked = updates.where("asked_stop IS NOT NULL OR asked_sequence IS NOT NULL").alias("u")
    fits = (F.col("u.trip_id") == F.col("t.trip_id")) & F.expr("(asked_stop IS NULL OR asked_stop = t.s.stop_id) AND (asked_sequence IS NULL OR asked_sequence = t.s.stop_sequence)")
    return asked.join(s.alias("t"), fits, "left").groupBy(*(F.col(f"u.{k}").alias(k) for k in keys), F.col("u.arrival").alias("arrival"), F.col("u.departure").alias("departure")).agg(F.min("t.s").alias("scheduled"))


def observations(feeds: DataFrame, schedule: DataFrame, zone: str = "America/Vancouver") -> DataFrame:
    """trip_id, stop_id, stop_sequence, service_date, scheduled_arrival, observed_at, delay_seconds of usable updates."""
    m = matched(stop_updates(feeds), schedule).where("scheduled IS NOT NULL")
    s, d = F.col("scheduled"), F.col("service_date")
    delay = F.coalesce(event_delay(F.col("arrival"), s["arrival"], d, zone), event_delay(F.col("departure"), F.coalesce(s["departure"], s["arrival"]), d, zone))
    return m.select("trip_id", s["stop_id"].alias("stop_id"), s["stop_sequence"].alias("stop_sequence"), "service_date", s["arrival"].alias("scheduled_arrival"), "observed_at", delay.alias("delay_seconds")).where("delay_seconds IS NOT NULL")


def counters(feeds: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row: trip_updates, stop_updates, malformed, unknown, unusable."""
    trips = trip_updates(feeds).agg(F.count(F.lit(1)).alias("trip_updates"), F.count_if(F.col("service_date").isNull()).alias("bad_trips"))
    ups = stop_updates(feeds)
    stops = ups.agg(F.count(F.lit(1)).alias("stop_updates"), F.count_if(F.col("asked_stop").isNull() & F.col("asked_sequence").isNull()).alias("bad_stops"))
    said = F.coalesce("arrival.delay", "arrival.time", "departure.delay", "departure.time").isNotNull()
    found = matched(ups, schedule).agg(F.count_if(F.col("scheduled").isNull()).alias("unknown"), F.count_if(F.col("scheduled").isNotNull() & ~said).alias("unusable"))
    row = trips.crossJoin(stops).crossJoin(found)  # single rows
    return row.select("trip_updates", "stop_updates", (F.col("bad_trips") + F.col("bad_stops")).alias("malformed"), "unknown", "unusable")


def new_observations(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Observations whose stop visit and time aren't stored yet, each once."""
    keys = ["trip_id", "stop_id", "stop_sequence", "service_date", "observed_at"]
    w = Window.partitionBy(*keys).orderBy(F.col("scheduled_arrival").asc_nulls_last(), "delay_seconds")
    return found.join(stored.select(*keys), keys, "left_anti").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def insert_counts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: inserted, the observations that new_observations gives, and duplicates, all others of found."""
    new = new_observations(found, stored).agg(F.count(F.lit(1)).alias("inserted"))
    return found.agg(F.count(F.lit(1)).alias("all")).crossJoin(new).select("inserted", (F.col("all") - F.col("inserted")).alias("duplicates"))  # single rows

"""Hops between stops, departures, transfers and stop search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gtfs import folded


def connections(stop_times: DataFrame, trips: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """A row for each two stops in a row of a trip. One shuffle by trip, whatever the number of columns."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    nxt = lambda c: F.lead(c).over(w)
    hops = stop_times.select(
        "trip_id", F.col("stop_id").alias("from_stop_id"), nxt("stop_id").alias("to_stop_id"), "departure_seconds", nxt("arrival_seconds").alias("arrival_seconds"),
        "stop_sequence", nxt("stop_sequence").alias("to_sequence"), F.coalesce("pickup_type", F.lit(0)).alias("pickup_type"), F.coalesce(nxt("drop_off_type"), F.lit(0)).alias("drop_off_type"),
    ).where("to_stop_id IS NOT NULL AND departure_seconds IS NOT NULL AND arrival_seconds IS NOT NULL")
    hops = hops.join(trips, "trip_id")
    return hops if routes is None else hops.join(routes, "route_id")


def departures(hops: DataFrame, stop_id, after: int, before: int | None = None, alighting: bool = True) -> DataFrame:
    """Boardings at a stop in a time range, ends included; with `alighting`, only those that can be left at the next stop."""
    at = hops.where((F.col("from_stop_id") == stop_id) & (F.col("departure_seconds") >= after) & (F.col("pickup_type") != 1))
    if before is not None:
        at = at.where(F.col("departure_seconds") <= before)
    return at.where("drop_off_type <> 1") if alighting else at


def stops_with_service(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    return stops.join(stop_times, "stop_id", "left_semi")


def search_stops(stops: DataFrame, stop_times: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Served stops whose name holds the text in any case, by name and id, 20 at most."""
    if len(text.strip()) < 2 or not 1 <= limit <= 20:
        raise ValueError("a search takes two characters or more and a limit from 1 to 20")
    return stops_with_service(stops, stop_times).where(F.contains(folded(F.col("stop_name")), folded(F.lit(text)))).orderBy("stop_name", "stop_id").limit(limit)


def station_transfers(stops: DataFrame, explicit: DataFrame, seconds: int = 120) -> DataFrame:
    """Explicit transfers, and one between each two stops of a station that have none. Stations are small."""
    a = stops.where("parent_station IS NOT NULL").select("parent_station", F.col("stop_id").alias("from_stop_id"))
    b = a.select("parent_station", F.col("from_stop_id").alias("to_stop_id"))
    made = a.join(b, "parent_station").where("from_stop_id <> to_stop_id").join(explicit, ["from_stop_id", "to_stop_id"], "left_anti")
    return explicit.select("from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time").unionByName(made.select("from_stop_id", "to_stop_id", F.lit(2).alias("transfer_type"), F.lit(seconds).alias("min_transfer_time")))


def same_stop_rules(transfers: DataFrame) -> DataFrame:
    return transfers.where("from_stop_id = to_stop_id").groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.max(F.coalesce("min_transfer_time", F.lit(0))).alias("min_seconds"), F.max((F.col("transfer_type") == 3).cast("int")).alias("forbidden"))


def ordered_pairs(stop_times: DataFrame, origin: Column, destination: Column) -> DataFrame:
    """Trips that stop at origin and later at destination."""
    o = stop_times.where(F.col("stop_id") == origin).select("trip_id", F.col("stop_sequence").alias("o_seq"))
    d = stop_times.where(F.col("stop_id") == destination).select("trip_id", F.col("stop_sequence").alias("d_seq"))
    return o.join(d, "trip_id").where("d_seq > o_seq")


def patterns(hops: DataFrame) -> DataFrame:
    """Trips with the same route, direction and stops, as one row. A trip's stops fit in a row; a pattern keeps a count."""
    per_trip = hops.groupBy("trip_id", "route_id", "direction_id").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "from_stop_id", "to_stop_id"))).alias("h"))
    stops = F.concat(F.col("h.from_stop_id"), F.array(F.element_at("h.to_stop_id", -1)))
    return per_trip.withColumn("stops", F.array_join(stops.cast("array<string>"), "|")).groupBy("route_id", "direction_id", "stops").agg(F.count(F.lit(1)).alias("trips"), F.min("trip_id").alias("first_trip"))

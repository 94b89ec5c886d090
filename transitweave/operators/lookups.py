"""Lookups by keys: many keys at once, as joins, so that a key costs no job of its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gtfs import route_name
from . import timetable


def with_ids(rows: DataFrame, column: str, ids: DataFrame | Iterable | None) -> DataFrame:
    """Rows whose column is among ids: a table of one column, a short list, or None for all rows."""
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return rows.where(F.col(column).isin(list(ids)))


def stops_like(stops: DataFrame, stop_times: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Served stops whose name holds the text in any case; % and _ in it stand for any characters."""
    found = timetable.stops_with_service(stops, stop_times).where(F.col("stop_name").ilike(f"%{text}%"))
    return found.orderBy("stop_name", "stop_id").limit(max(1, limit))


def feed_version(feed_info: DataFrame) -> DataFrame:
    """One row: the greatest version, else first and last day joined by a colon. Without rows that is a lone colon."""
    text = lambda c: F.coalesce(F.max(c).cast("string"), F.lit(""))
    return feed_info.agg(F.coalesce(F.max("feed_version"), F.concat(text("feed_start_date"), F.lit(":"), text("feed_end_date"))).alias("version"))


def profile_version(profiles: DataFrame, column: str = "updated_at") -> DataFrame:
    return profiles.agg(F.coalesce(F.max(column).cast("string"), F.lit("no-profiles")).alias("version"))


def service_date_of(moment: Column, zone: str = "America/Vancouver") -> Column:
    """The date of a moment by the clock of `zone`, whatever the session's zone."""
    return F.to_date(F.convert_timezone(None, F.lit(zone), moment))


def trip_connections(stop_times: DataFrame, trips: DataFrame, ids: DataFrame | Iterable | None, from_sequence: int = 0) -> DataFrame:
    """Hops of trips from a sequence on. Other trips are left out before stops are put in order."""
    hops = timetable.connections(with_ids(stop_times, "trip_id", ids), trips)
    return hops.where(F.col("stop_sequence") >= from_sequence)


def hops_of_stop(stop_times: DataFrame, trips: DataFrame, stop_id: int) -> DataFrame:
    """Hops of the trips that call at a stop: the rest of the timetable is neither shuffled nor sorted."""
    calls = stop_times.where(F.col("stop_id") == stop_id).select("trip_id")
    return timetable.connections(stop_times.join(calls, "trip_id", "left_semi"), trips)


def calls_paired(stop_times: DataFrame) -> DataFrame:
    """trip_id, from_stop_id, to_stop_id, departure_seconds, arrival_seconds of each two calls of a trip. A trip has few calls."""
    o = stop_times.select("trip_id", F.col("stop_id").alias("from_stop_id"), F.col("stop_sequence").alias("o"), "departure_seconds")
    d = stop_times.select("trip_id", F.col("stop_id").alias("to_stop_id"), F.col("stop_sequence").alias("d"), "arrival_seconds")
    return o.join(d, "trip_id").where("d > o").drop("o", "d")


def legs_known(legs: DataFrame, stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """legs with `present`: whether their trip of their route makes that ride at those times, between stops of those names.

    legs: trip_id, route_id, from_stop_id, to_stop_id, from_name, to_name, departure_seconds, arrival_seconds.
    """
    keys = ["trip_id", "route_id", "from_stop_id", "to_stop_id", "from_name", "to_name", "departure_seconds", "arrival_seconds"]
    wanted = stop_times.join(legs.select("trip_id"), "trip_id", "left_semi")
    name = lambda side: stops.select(F.col("stop_id").alias(f"{side}_stop_id"), F.col("stop_name").alias(f"{side}_name"))
    real = calls_paired(wanted).join(trips.select("trip_id", "route_id"), "trip_id").join(name("from"), "from_stop_id").join(name("to"), "to_stop_id")
    return legs.join(real.select(*keys).distinct().withColumn("present", F.lit(True)), keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def profiles_for(exact: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact profiles whose route and window are both in keys (route_id, time_window), of any pair and all directions."""
    routes, windows = keys.select("route_id").distinct(), keys.select("time_window").distinct()
    return exact.join(routes, "route_id", "left_semi").join(windows, "time_window", "left_semi")


def fallback_profiles(profiles) -> DataFrame:
    """profile_level, route_key, direction_key and numbers of all parents of exact profiles, keyed as they are looked up: * and -1 for any."""
    numbers = ["n", "dates", "on_time", "reliability"]
    some, every = F.lit(-1).cast("long"), F.lit("*")
    parts = [
        profiles.route_direction().select(F.lit("route_direction").alias("profile_level"), F.col("route_id").cast("string").alias("route_key"), F.col("direction_key").cast("long").alias("direction_key"), *numbers),
        profiles.route().select(F.lit("route").alias("profile_level"), F.col("route_id").cast("string").alias("route_key"), some.alias("direction_key"), *numbers),
        profiles.network().select(F.lit("network").alias("profile_level"), every.alias("route_key"), some.alias("direction_key"), *numbers),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def integration_cases(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame, first_dates: DataFrame, limit: int, trips_most: int = 500) -> DataFrame:
    """Real journeys to test a planner with: of the first trip of each route, a pair of stops that no other has taken.

    first_dates: service_id, service_date. Pairs go from a stop where one can board to the last later
    one where one can leave. Journeys after midnight come first. trips_most bounds the sample, which is
    what this operator makes.
    """
    row = lambda *order: F.row_number().over(Window.partitionBy(*order[0]).orderBy(*order[1]))
    sampled = trips.withColumn("k", row(["route_id"], ["trip_id"])).where("k = 1").orderBy("route_id", "trip_id").limit(trips_most).select("trip_id", "service_id", "route_id")
    calls = stop_times.join(F.broadcast(sampled.select("trip_id")), "trip_id", "left_semi")
    o = calls.where("departure_seconds IS NOT NULL AND coalesce(pickup_type, 0) <> 1").select("trip_id", F.col("stop_id").alias("origin"), F.col("stop_sequence").alias("o"), F.col("departure_seconds").alias("departure"))
    d = calls.where("arrival_seconds IS NOT NULL AND coalesce(drop_off_type, 0) <> 1").select("trip_id", F.struct("stop_sequence", "stop_id", "arrival_seconds").alias("d"))
    pairs = o.join(d, "trip_id").where("d.stop_sequence > o AND d.stop_id <> origin").groupBy("trip_id", "origin", "o", "departure").agg(F.max("d").alias("d"))
    cases = pairs.join(sampled, "trip_id").join(first_dates, "service_id").withColumn("destination", F.col("d.stop_id"))
    cases = cases.withColumn("k", row(["origin", "destination"], ["service_date", "departure", "trip_id", "o"])).where("k = 1")
    cases = cases.withColumn("k", row(["route_id"], ["service_date", "departure", "trip_id", "origin", "destination"])).where("k = 1")
    name = lambda side: stops.select(F.col("stop_id").alias(side), F.col("stop_name").alias(f"{side}_name"))
    cases = cases.join(name("origin"), "origin").join(name("destination"), "destination").join(routes, "route_id")
    cases = cases.orderBy(F.desc(F.col("departure") >= 86400), "service_date", "route_id", "trip_id", "origin", "destination").limit(limit)
    return cases.select(
        "origin", "origin_name", "destination", "destination_name", "service_date", "departure", "trip_id", "route_id",
        route_name(F.col("short_name"), F.col("long_name"), F.col("route_id")).alias("route_name"), F.col("d.arrival_seconds").alias("arrival"),
    )


def speed_bound(edges: DataFrame, margin: float = 1.001) -> DataFrame:
    """One row: enabled, meters_per_second, edges, reason. edges: metres, seconds, kind.

    The greatest speed over edges that lead elsewhere, with a margin. An edge that takes no time, or that has
    no place (metres null), switches the bound off, with the reason.
    """
    moves = edges.where("metres IS NULL OR metres > 0")
    seen = moves.agg(
        F.max(F.col("metres") / F.when(F.col("seconds") > 0, F.col("seconds"))).alias("most"), F.count(F.lit(1)).alias("edges"),
        F.min(F.when(F.col("metres").isNull(), F.concat(F.lit("a place is missing: "), "kind")).when(F.col("seconds") <= 0, F.concat(F.lit("takes no time: "), "kind"))).alias("fault"),
    )
    reason = F.coalesce("fault", F.when(F.col("edges") == 0, "no edge leads elsewhere"))
    return seen.select(
        reason.isNull().alias("enabled"), F.when(reason.isNull(), F.round(F.col("most") * margin, 6)).alias("meters_per_second"), "edges", reason.alias("reason")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows: one row per table, all counted in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def response_hash(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: SHA-256 of a short result's rows as JSON, in order."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select(F.struct(*order).alias("o"), line.alias("line")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("o", "line")))["line"], "\n"), 256).alias("hash"))

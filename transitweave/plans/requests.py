"""Journey requests: checked when they are made, planned together in one search, answered as nested rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gtfs import percent_score, time_window
from ..operators import journeys as jo
from ..operators.boarding import prepared
from ..operators.keep import kept
from ..operators.reliability import Profiles, resolved

#: All give the same journeys by design; each answer has the name that was asked for.
ALGORITHMS = ("mc_raptor", "dijkstra", "astar")


@dataclass(frozen=True)
class JourneyRequest:
    """What a traveller asks for. Values out of bounds raise ValueError."""

    origin: int | str
    destination: int | str
    departure_time: str
    algorithm: str = "mc_raptor"
    include_alternatives: bool = False
    max_transfers: int = 3
    max_extra_minutes: int = 30
    timeout_seconds: float = 30.0
    reliability_effect: float = 0.5
    travel_time_effect: float = 0.5
    transfer_effect: float = 0.0
    limit: int = 3
    minimum_samples: int = 20

    def __post_init__(self) -> None:
        for name in ("origin", "destination"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, value.strip())
            if getattr(self, name) in ("", None):
                raise ValueError(f"{name} must not be blank")
        effects = (self.reliability_effect, self.travel_time_effect, self.transfer_effect)
        wrong = {
            "origin and destination must differ": self.origin == self.destination,
            "departure_time must be H:MM:SS": not re.fullmatch(r"\d+:[0-5]\d:[0-5]\d", self.departure_time.strip()),
            f"algorithm must be one of {', '.join(ALGORITHMS)}": self.algorithm.strip().lower() not in ALGORITHMS,
            "max_transfers must not be negative": self.max_transfers < 0,
            "max_extra_minutes must be from 0 to 120": not 0 <= self.max_extra_minutes <= 120,
            "timeout_seconds must be over 0 and up to 120": not 0 < self.timeout_seconds <= 120,
            "effects must not be negative, and not all 0": min(effects) < 0 or not sum(effects),
            "limit must be 1 or more": self.limit < 1,
            "minimum_samples must be 1 or more": self.minimum_samples < 1,
        }
        for what, is_so in wrong.items():
            if is_so:
                raise ValueError(what)

    @property
    def seconds(self) -> int:
        h, m, s = map(int, self.departure_time.strip().split(":"))
        return h * 3600 + m * 60 + s


def _stop(value: int | str, kind: str) -> int | str:
    """A stop id as the network has them; a text that is no number where they are numbers raises ValueError."""
    return str(value) if kind == "string" else int(value)


def answered(spark: SparkSession, requests: list[JourneyRequest], hops: DataFrame, transfers: DataFrame, stops: DataFrame, profiles: Profiles, horizon: int = 10800, deadline_s: float | None = None) -> DataFrame:
    """query_id (the request's place in the list), rank, algorithm, departure, arrival, duration, transfers, reliability, score, insufficient, legs.

    Stop ids are numbers or text, as in hops. Requests with the same bounds are searched together, all over a network prepared once. Without
    alternatives, only the best is in the answer. insufficient says whether a leg's profile has fewer samples than the request asks for.
    A passed deadline raises.
    """
    if not requests:
        raise ValueError("no requests")
    kind = hops.schema["from_stop_id"].dataType.simpleString()
    profiles = profiles.kept()
    net = prepared(hops, transfers, profiles, horizon)
    out = None
    shared: dict[tuple, list[int]] = {}
    for k, r in enumerate(requests):
        shared.setdefault((r.max_transfers, r.max_extra_minutes, r.reliability_effect, r.travel_time_effect, r.transfer_effect, r.limit if r.include_alternatives else 1), []).append(k)
    for (most, extra, *weights, limit), own in shared.items():
        asked = [(k, _stop(requests[k].origin, kind), _stop(requests[k].destination, kind), requests[k].seconds, horizon, requests[k].algorithm.strip().lower(), requests[k].minimum_samples) for k in own]
        searches = spark.createDataFrame(asked, f"query_id int, origin {kind}, destination {kind}, departure long, horizon long, algorithm string, minimum_samples int")
        found = jo.search(searches, net, most, extra * 60, deadline_s or min(requests[k].timeout_seconds for k in own))
        part = _ranked(found.join(searches.select("query_id", "departure", "algorithm", "minimum_samples"), "query_id"), tuple(weights), limit)
        out = part if out is None else out.unionByName(part)
    return _nested(kept(out, "answers"), hops, stops, profiles)


def _ranked(found: DataFrame, weights: tuple[float, float, float], limit: int) -> DataFrame:
    one = Window.partitionBy("query_id")
    rows = found.withColumn("duration", F.col("arrival") - F.col("departure")).withColumn("fastest", F.min("duration").over(one))
    rows = rows.withColumn("score", F.round(percent_score(F.col("reliability"), F.col("duration"), F.col("fastest"), F.col("transfers"), weights), 6))
    order = one.orderBy(F.desc("score"), F.desc("reliability"), "arrival", "transfers", "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("fastest", "cost")


def _nested(rows: DataFrame, hops: DataFrame, stops: DataFrame, profiles: Profiles) -> DataFrame:
    """Legs as an array of structs with their stops and profiles, in order of the path."""
    keys = ["query_id", "rank"]
    legs = jo.legs_of(rows, keys)
    routes = hops.select("trip_id", "route_id", "direction_id").join(legs.select("trip_id"), "trip_id", "left_semi").distinct()
    legs = resolved(legs.join(routes, "trip_id").withColumn("time_window", time_window(F.col("arrival"))), profiles).drop("insufficient")
    calls = jo.leg_stops(legs, hops, keys).join(stops.select("stop_id", "stop_name"), "stop_id", "left")
    calls = calls.groupBy(*keys, "position").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id", "stop_name", "arrival", "departure"))).alias("stops"))
    leg = F.struct("position", "trip_id", "route_id", "from_stop", "to_stop", "departure", "arrival", (F.col("arrival") - F.col("departure")).alias("duration"), "level", F.col("reliability").alias("probability"), F.col("n").alias("samples"), "stops")
    nested = legs.join(calls, [*keys, "position"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    whole = rows.drop("path").join(nested, keys, "left").withColumn("insufficient", F.expr("exists(legs, l -> l.samples < minimum_samples)"))
    return whole.select(*keys, "algorithm", "departure", "arrival", "duration", "transfers", "reliability", "score", "insufficient", "legs")

"""Journey search in rounds: a join for each boarding, many origins in one job."""

from __future__ import annotations

import time
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gtfs import leg_cost, percent_score
from .keep import kept, kept_by


#: From when one can board where one has come by a ride; null where the stop's rules forbid it.
_READY = "if(coalesce(forbidden, false), NULL, arrival + coalesce(wait, 0)) AS ready"
_BETTER = "old IS NULL OR arrival < old OR coalesce(ready < old_ready, old_ready IS NULL AND ready IS NOT NULL)"


class SearchLimit(RuntimeError):
    """A search passed its deadline or its number of labels; there is no partial result."""


def _stop_rules(transfers: DataFrame) -> DataFrame:
    """stop_id, wait, forbidden: what holds for boarding where one has got off."""
    rules = transfers.where("from_stop_id = to_stop_id").groupBy(F.col("from_stop_id").alias("stop_id"))
    return rules.agg(F.max(F.coalesce("min_transfer_time", F.lit(0))).alias("wait"), F.max(F.col("transfer_type") == 3).alias("forbidden"))


def _network(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What can be boarded, dealt by stop, and where one can get off, dealt by trip and part. So no round moves the network, however many there are."""
    calls = hops.withColumn("boards", F.expr("pickup_type <> 1 AND drop_off_type <> 1"))
    calls = kept_by(calls.select("trip_id", "part", "stop_sequence", "from_stop_id", "to_stop_id", "departure_seconds", "arrival_seconds", "boards"), ["trip_id", "part"], "calls")
    boards = kept_by(calls.where("boards").select(F.col("from_stop_id").alias("stop_id"), "departure_seconds", "trip_id", "part", "stop_sequence"), ["stop_id"], "boards")
    return boards, calls.select("trip_id", "part", "stop_sequence", F.col("to_stop_id").alias("stop_id"), F.col("arrival_seconds").alias("arrival"))


def _rides(frontier: DataFrame, boards: DataFrame, later: DataFrame) -> DataFrame:
    """query_id, stop_id, arrival: where a frontier gets by a ride. latest: the last departure that counts, null: none.

    Departures from old_ready on were boarded when the stop was reached before, so a
    search boards each at most once.
    """
    new = "departure_seconds >= ready AND (old_ready IS NULL OR departure_seconds < old_ready) AND (latest IS NULL OR departure_seconds <= latest)"
    board = frontier.join(boards, "stop_id").where(new).select("query_id", "trip_id", "part", "stop_sequence").repartition("trip_id", "part")
    board = board.groupBy("query_id", "trip_id", "part").agg(F.min("stop_sequence").alias("from_sequence"))
    return board.join(later, ["trip_id", "part"]).where("stop_sequence >= from_sequence").groupBy("query_id", "stop_id").agg(F.min("arrival").alias("arrival"))


def closed_walks(transfers: DataFrame) -> DataFrame:
    """from_stop_id, to_stop_id, seconds: the shortest way on foot over any number of transfers, also back to where it began.

    Rounds double the number of transfers until nothing is shorter. Stops that
    are linked on foot are a station and its neighbours, so the result is small.
    """
    keys = ["from_stop_id", "to_stop_id"]
    least = F.min("seconds").alias("seconds")
    walks = kept(transfers.where("transfer_type <> 3 AND from_stop_id <> to_stop_id").groupBy(*keys).agg(F.min(F.coalesce("min_transfer_time", F.lit(0))).cast("long").alias("seconds")))
    while True:
        on = walks.select(F.col("from_stop_id").alias("to_stop_id"), F.col("to_stop_id").alias("end"), F.col("seconds").alias("more"))
        further = walks.join(on, "to_stop_id").select("from_stop_id", F.col("end").alias("to_stop_id"), (F.col("seconds") + F.col("more")).alias("seconds"))
        longer = kept(walks.unionByName(further).groupBy(*keys).agg(least))
        if longer.join(walks, [*keys, "seconds"], "left_anti").isEmpty():
            return longer
        walks = longer


def arrivals_by_boardings(origins: DataFrame, hops: DataFrame, transfers: DataFrame, boardings: int = 4, horizon: int = 10800, deadline_s: float | None = None) -> DataFrame:
    """query_id, stop_id, boardings, arrival: earliest arrivals with so many boardings, where fewer don't do as well.

    origins: query_id, stop_id, arrival (the time asked for). A trip is boarded at
    or after the time from which a stop can board and left at any later stop;
    departures after the horizon don't count. Walks come before the first ride and
    after any. transfers may hold rules of a stop with itself, as in
    earliest_to_fixpoint: they hold where one has come by a ride.
    """
    limit = time.monotonic() + deadline_s if deadline_s else None
    start = origins.select("query_id", (F.col("arrival") + horizon).alias("latest"))
    walks, rules = closed_walks(transfers), _stop_rules(transfers)
    boards, later = _network(hops.withColumn("part", F.lit(0)))
    ends = [F.min("arrival").alias("arrival"), F.min("ready").alias("ready")]

    def on_foot(labels: DataFrame) -> DataFrame:
        reached = labels.join(walks, F.col("stop_id") == F.col("from_stop_id")).select("query_id", F.col("to_stop_id").alias("stop_id"), (F.col("arrival") + F.col("seconds")).alias("arrival"))
        return labels.unionByName(reached.withColumn("ready", F.col("arrival"))).groupBy("query_id", "stop_id").agg(*ends)

    best = kept(on_foot(origins.select("query_id", "stop_id", "arrival", F.col("arrival").alias("ready"))))
    frontier, out = best.withColumn("old_ready", F.lit(None).cast("long")), best.select("query_id", "stop_id", F.lit(0).alias("boardings"), "arrival")
    for k in range(1, boardings + 1):
        if limit and time.monotonic() > limit:
            raise SearchLimit("the search passed its deadline")
        ride = _rides(frontier.join(start, "query_id"), boards, later)
        ride = ride.join(rules, "stop_id", "left").selectExpr("query_id", "stop_id", "arrival", _READY)
        old = best.withColumnsRenamed({"arrival": "old", "ready": "old_ready"})
        both = kept(on_foot(ride).join(old, ["query_id", "stop_id"], "left").where(_BETTER))
        frontier = both.drop("old")
        if frontier.isEmpty():
            break
        out = out.unionByName(both.where("old IS NULL OR arrival < old").select("query_id", "stop_id", F.lit(k).alias("boardings"), "arrival"))
        best = kept(best.unionByName(frontier.drop("old_ready")).groupBy("query_id", "stop_id").agg(*ends))
    return out


def earliest_arrivals(origins: DataFrame, hops: DataFrame, transfers: DataFrame, boardings: int = 4, horizon: int = 10800, deadline_s: float | None = None) -> DataFrame:
    """query_id, stop_id, arrival: earliest arrivals with up to `boardings` boardings."""
    return arrivals_by_boardings(origins, hops, transfers, boardings, horizon, deadline_s).groupBy("query_id", "stop_id").agg(F.min("arrival").alias("arrival"))


def earliest_to_fixpoint(origins: DataFrame, hops: DataFrame, transfers: DataFrame, deadline_s: float | None = None) -> DataFrame:
    """query_id, stop_id, arrival: earliest arrivals with any number of boardings and walks, without a horizon.

    hops: those of the services of one day. transfers may hold rules of a stop with
    itself: after a ride, another trip can be boarded there only that many seconds
    later, or (type 3) not at all. So a label has its arrival and, apart from it,
    the time from which it can board. Rules of single trips are not known here.
    """
    limit = time.monotonic() + deadline_s if deadline_s else None
    walks = transfers.where("transfer_type <> 3 AND from_stop_id <> to_stop_id").groupBy("from_stop_id", "to_stop_id").agg(F.min(F.coalesce("min_transfer_time", F.lit(0))).alias("seconds"))
    rules = _stop_rules(transfers)
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    broken = (F.col("from_stop_id") != F.lag("to_stop_id").over(w)) | (F.col("departure_seconds") < F.lag("arrival_seconds").over(w))
    hops = hops.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int")).withColumn("part", F.sum("broken").over(w))
    boards, later = _network(hops)
    ends = [F.min("arrival").alias("arrival"), F.min("ready").alias("ready")]
    best = kept(origins.select("query_id", "stop_id", "arrival", F.col("arrival").alias("ready")).groupBy("query_id", "stop_id").agg(*ends))
    none = F.lit(None).cast("long")
    frontier = best.withColumn("old_ready", none)
    while not frontier.isEmpty():
        if limit and time.monotonic() > limit:
            raise SearchLimit("the search passed its deadline")
        ride = _rides(frontier.withColumn("latest", none), boards, later)
        ride = ride.join(rules, "stop_id", "left").selectExpr("query_id", "stop_id", "arrival", _READY)
        walk = frontier.join(walks, F.col("stop_id") == F.col("from_stop_id")).select("query_id", F.col("to_stop_id").alias("stop_id"), (F.col("arrival") + F.col("seconds")).alias("arrival"))
        new = ride.unionByName(walk.withColumn("ready", F.col("arrival"))).groupBy("query_id", "stop_id").agg(*ends)
        old = best.withColumnsRenamed({"arrival": "old", "ready": "old_ready"})
        frontier = kept(new.join(old, ["query_id", "stop_id"], "left").where(_BETTER).drop("old"))
        best = kept(best.unionByName(frontier.drop("old_ready")).groupBy("query_id", "stop_id").agg(*ends))
    return best.drop("ready")


#: Rows of a piece that is compared row by row: two to the power of this.
_PIECE = 10


def pareto(alternatives: DataFrame, group: list[str]) -> DataFrame:
    """Rows for which no other of their group is as good in arrival, cost and transfers and better in one. Equal rows stay once.

    Rows stand by group, arrival, cost and transfers, in pieces of about a thousand, so that one
    group spreads over all tasks. Only a row that stands earlier can be better. Of each piece and number of
    transfers the least cost is known; running minima over transfers and pieces give what all earlier
    pieces undercut, a row for each piece and number of transfers. Inside a piece the rows left are joined with
    each other.
    """
    values = ["arrival", "cost", "transfers"]
    best = alternatives.dropDuplicates([*group, *values])
    rows = best.select(F.struct(*group).alias("g"), *values)
    rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", *values).sortWithinPartitions("g", *values)
    rows = kept(rows.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), _PIECE)), "pieces")
    least = rows.groupBy("g", "piece", "transfers").agg(F.min("cost").alias("cost"))
    every = least.select("g", "piece").distinct().join(least.select("g", "transfers").distinct(), "g").join(least, ["g", "piece", "transfers"], "left")
    fewer = every.withColumn("cost", F.min("cost").over(Window.partitionBy("g", "piece").orderBy("transfers")))
    before = Window.partitionBy("g", "transfers").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.join(fewer.select("g", "piece", "transfers", F.min("cost").over(before).alias("before")), ["g", "piece", "transfers"]).where("before IS NULL OR cost < before")
    other = left.select(*(F.col(c).alias(f"o_{c}") for c in ["g", "piece", *values]))
    as_good = [F.col(f"o_{c}") <= F.col(c) for c in values]
    better = reduce(or_, [F.col(f"o_{c}") < F.col(c) for c in values])
    left = left.join(other, reduce(and_, [F.col("g") == F.col("o_g"), F.col("piece") == F.col("o_piece"), *as_good, better]), "left_anti")
    keys = left.select(*(F.col(f"g.{c}").alias(f"k_{c}") for c in group), *(F.col(c).alias(f"k_{c}") for c in values))
    return best.join(keys, reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in [*group, *values]]), "left_semi")


def direct_alternatives(hops: DataFrame, origin: int, destination: int, after: int, horizon: int = 10800) -> DataFrame:
    """Rides without a change: trip, departure, arrival and the window of the departure."""
    o = hops.where((F.col("from_stop_id") == origin) & F.col("departure_seconds").between(after, after + horizon)).select("trip_id", "route_id", "direction_id", F.col("stop_sequence").alias("o_seq"), F.col("departure_seconds").alias("departure"))
    d = hops.where(F.col("to_stop_id") == destination).select("trip_id", F.col("stop_sequence").alias("d_seq"), F.col("arrival_seconds").alias("arrival"))
    return o.join(d, "trip_id").where("d_seq >= o_seq").select("trip_id", "route_id", "direction_id", "departure", "arrival")


def ranked(alternatives: DataFrame, limit: int = 3, weights: tuple[float, float, float] = (0.5, 0.5, 0.0)) -> DataFrame:
    """The best alternatives by score, reliability, arrival, transfers and trip."""
    rows = alternatives.withColumn("duration", F.col("arrival") - F.col("departure"))
    fastest = rows.agg(F.min("duration").alias("fastest"))
    rows = rows.crossJoin(F.broadcast(fastest))  # a single row
    rows = rows.withColumn("score", F.round(percent_score(F.col("reliability"), F.col("duration"), F.col("fastest"), F.col("transfers"), weights), 6)).drop("fastest")
    top = rows.orderBy(F.desc("score"), F.desc("reliability"), "arrival", "transfers", "trip_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("reliability"), "arrival", "transfers", "trip_id")))


def with_costs(alternatives: DataFrame) -> DataFrame:
    return alternatives.withColumn("transfers", F.lit(0)).withColumn("cost", F.round(leg_cost(F.col("reliability")), 9))

"""What a journey search needs of a network, prepared once: which trip a label boards, what a ride costs, where one can walk.

Trips with the same route, direction, stops and boarding rules are a pattern. Trips of a
pattern none of which passes another make a chain, and of a chain the first trip that
can be caught reaches every later stop first. So a label boards one trip of
each chain and place in it, found by an as-of range join: each departure is stored with the times from
which it is the next one, cut into quarters of an hour, so that a busy stop is many
keys. A later trip of a chain can be better only where it arrives in another window of the
day than the one before it, and so at other odds; such trips are few and kept apart. Trips
that transfer rules name are boarded one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.gtfs import leg_cost, time_window
from .keep import kept
from .reliability import Profiles, resolved
from .search import closed_walks

QUARTER = 900
_TRIP_RULES = ["from_trip_id", "to_trip_id"]


@dataclass(frozen=True)
class Prepared:
    """catch: departures by stop and quarter from which they are next. openers: later trips that open a window somewhere. named: departures of named trips.

    boards: stop_id, trip_id, position, departure of all that can be boarded. later: trip_id, position, to_sequence, to_stop, reached, leg_cost, opens, named. rules: stop_id and the rules of boarding there as an array.
    walks: ways on foot over any number of transfers.
    """

    catch: DataFrame
    openers: DataFrame
    named: DataFrame | None
    boards: DataFrame
    later: DataFrame
    rules: DataFrame
    walks: DataFrame
    stop_type: DataType
    trip_type: DataType


def calls_of_patterns(hops: DataFrame) -> DataFrame:
    """Hops with their position in the trip, `first`, when the trip starts, and `pattern`, a 128-bit digest of route, direction, stops and boarding rules."""
    trip = Window.partitionBy("trip_id")
    calls = hops.select(
        "trip_id", "route_id", "direction_id", F.row_number().over(trip.orderBy("stop_sequence")).alias("position"), "stop_sequence", F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"),
        F.col("departure_seconds").cast("long").alias("departure"), F.col("arrival_seconds").cast("long").alias("reached"), F.expr("pickup_type <> 1 AND drop_off_type <> 1").alias("boards"), F.min("departure_seconds").over(trip).alias("first"),
    )
    stops = F.sort_array(F.collect_list(F.struct("position", "from_stop", "to_stop", "boards")).over(trip))  # a trip's calls are few
    shape = F.to_json(F.struct(F.col("route_id").alias("r"), F.col("direction_id").alias("d"), stops.alias("s")))
    return calls.withColumn("pattern", F.md5(shape.cast("binary")))


def boarded_between(hops: DataFrame, earliest: int, latest: int) -> DataFrame:
    """Whole trips that can be boarded somewhere between these times, ends included: others carry no search that begins and ends there."""
    boards = F.col("departure_seconds").between(earliest, latest) & (F.col("pickup_type") != 1) & (F.col("drop_off_type") != 1)
    return hops.withColumn("in_time", F.max(boards).over(Window.partitionBy("trip_id"))).where("in_time").drop("in_time")


def chains(calls: DataFrame) -> DataFrame:
    """calls with `level`: trips of one pattern and level never pass each other.

    A trip that is earlier anywhere than one that started before it goes to the next
    level; the first of each level stays, so this ends. Timetables have two or three levels.
    """
    out, rest, level = None, kept(calls, "calls"), 0
    before = Window.partitionBy("pattern", "position").orderBy("first", "trip_id").rowsBetween(Window.unboundedPreceding, -1)
    passes = (F.col("departure") < F.max("departure").over(before)) | (F.col("reached") < F.max("reached").over(before))
    while True:
        passing = kept(rest.withColumn("passes", passes).where("passes").select("trip_id").distinct(), "passing")
        own = rest.join(passing, "trip_id", "left_anti").withColumn("level", F.lit(level))
        out = own if out is None else out.unionByName(own)
        if passing.isEmpty():
            return out
        rest, level = kept(rest.join(passing, "trip_id", "left_semi"), "calls"), level + 1


def chained_walks(transfers: DataFrame) -> DataFrame:
    """from_stop_id, to_stop_id, from_trip_id, to_trip_id, seconds: the shortest ways on foot over any number of transfers.

    Only the first may ask for the trip one has come by, as a walker holds none, and only what the last says of the trip to take holds.
    """
    one = transfers.where("transfer_type <> 3 AND from_stop_id <> to_stop_id").select("from_stop_id", "to_stop_id", *_TRIP_RULES, F.coalesce("min_transfer_time", F.lit(0)).cast("long").alias("seconds"))
    free = one.where("from_trip_id IS NULL")
    between = closed_walks(transfers.where("from_trip_id IS NULL")).select(F.col("from_stop_id").alias("a"), F.col("to_stop_id").alias("b"), F.col("seconds").alias("more"))
    ends = free.select("from_stop_id").distinct()
    between = between.unionByName(ends.select(F.col("from_stop_id").alias("a"), F.col("from_stop_id").alias("b"), F.lit(0).cast("long").alias("more")))
    on = free.select(F.col("from_stop_id").alias("b"), F.col("to_stop_id").alias("end"), F.col("to_trip_id").alias("then"), F.col("seconds").alias("last"))
    longer = one.withColumnRenamed("to_stop_id", "a").join(between, "a").join(on, "b").select("from_stop_id", F.col("end").alias("to_stop_id"), "from_trip_id", F.col("then").alias("to_trip_id"), (F.col("seconds") + F.col("more") + F.col("last")).alias("seconds"))
    return one.unionByName(longer).groupBy("from_stop_id", "to_stop_id", *_TRIP_RULES).agg(F.min("seconds").alias("seconds"))


def prepared(hops: DataFrame, transfers: DataFrame, profiles: Profiles, horizon: int, between: tuple[int, int] | None = None) -> Prepared:
    """For searches that end `horizon` seconds after their departure at most, with `between` for those alone that begin and end between two times. See journeys for the columns."""
    if between:
        hops = boarded_between(hops, *between)
    rules = transfers.where("from_stop_id = to_stop_id").select(F.col("from_stop_id").alias("stop_id"), *_TRIP_RULES, "transfer_type", F.coalesce("min_transfer_time", F.lit(0)).alias("wait"))
    names = kept(transfers.select(F.explode(F.array(*_TRIP_RULES)).alias("trip_id")).where("trip_id IS NOT NULL").distinct().withColumn("named", F.lit(True)), "named-trips")
    some = not names.isEmpty()
    rows = chains(calls_of_patterns(hops))
    chain = Window.partitionBy("pattern", "level", "position").orderBy("first", "trip_id")
    rows = rows.withColumn("previous", F.lag("departure").over(chain)).withColumn("opens", F.coalesce(time_window(F.col("reached")) != time_window(F.lag("reached").over(chain)), F.lit(False)))
    rows = rows.withColumn("opener", F.max("opens").over(Window.partitionBy("trip_id")))
    rows = rows.join(names, "trip_id", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    costed = resolved(rows.withColumn("time_window", time_window(F.col("reached"))), profiles).withColumn("leg_cost", leg_cost(F.col("reliability")))
    rows = kept(costed.select("trip_id", "position", "stop_sequence", "from_stop", "to_stop", "departure", "reached", "boards", "previous", "opens", "opener", "named", "leg_cost"), "rides")

    board = [F.col("from_stop").alias("stop_id"), F.col("trip_id").alias("board_trip"), F.col("position").alias("board_position"), F.col("stop_sequence").alias("from_sequence"), "departure"]
    low = F.greatest(F.col("departure") - horizon, F.col("previous") + 1)  # greatest skips a null
    in_time = rows if not between else rows.where(F.col("departure").between(*between))
    if between:
        low = F.greatest(low, F.lit(between[0]))
    catch = in_time.where("boards AND NOT named").withColumn("low", low).where("low <= departure")
    catch = catch.select(*board, "low", F.explode(F.sequence(F.expr(f"floor(low / {QUARTER})"), F.expr(f"floor(departure / {QUARTER})"))).alias("quarter"))
    return Prepared(
        catch=kept(catch, "catch"),
        openers=in_time.where("boards AND opener AND NOT named").select(*board),
        named=in_time.where("boards AND named").select(*board) if some else None,
        boards=in_time.where("boards").select(F.col("from_stop").alias("stop_id"), "trip_id", "position", "departure"),
        later=rows.select("trip_id", "position", F.col("stop_sequence").alias("to_sequence"), "to_stop", "reached", "leg_cost", "opens", "named"),
        rules=kept(rules.groupBy("stop_id").agg(F.collect_set(F.struct(*_TRIP_RULES, "transfer_type", "wait")).alias("rules")), "stop-rules"),  # the rules of a stop are few
        walks=kept(chained_walks(transfers), "walks"),
        stop_type=hops.schema["from_stop_id"].dataType,
        trip_type=hops.schema["trip_id"].dataType,
    )


def _matching(trip: str) -> str:
    """Rules that hold for a label that would board `trip`, a column or null."""
    return f"filter(rules, r -> (r.from_trip_id IS NULL OR r.from_trip_id <=> last_trip) AND (r.to_trip_id IS NULL OR r.to_trip_id <=> {trip}))"


def boardings(labels: DataFrame, net: Prepared) -> DataFrame:
    """What labels (stop_id, arrival, until, last_trip, required_trip and others) board: adds board_trip, board_position, from_sequence, departure, only_opens."""
    ruled = labels.join(net.rules, "stop_id", "left")
    may = "NOT coalesce(exists(matching, r -> r.transfer_type = 3), false)"
    free = ruled.where("required_trip IS NULL").withColumn("matching", F.expr(_matching("NULL"))).where(may).withColumn("ready", F.expr("arrival + coalesce(array_max(transform(matching, r -> r.wait)), 0)")).drop("rules", "matching")
    free = free.withColumn("quarter", F.expr(f"floor(ready / {QUARTER})"))
    boards = "departure <= until AND (last_trip IS NULL OR board_trip <> last_trip)"
    caught = free.join(net.catch, ["stop_id", "quarter"]).where("ready BETWEEN low AND departure").drop("low").withColumn("only_opens", F.lit(False))
    opened = free.join(net.openers, "stop_id").where("departure >= ready").withColumn("only_opens", F.lit(True))
    out = caught.unionByName(opened).drop("quarter", "ready").where(boards)
    if net.named is not None:
        named = ruled.join(net.named, "stop_id").where(boards).where("required_trip IS NULL OR required_trip = board_trip").withColumn("matching", F.expr(_matching("board_trip"))).where(may)
        named = named.where("departure >= arrival + coalesce(array_max(transform(matching, r -> r.wait)), 0)").drop("rules", "matching").withColumn("only_opens", F.lit(False))
        out = out.unionByName(named)
    return out


def latest_times(searches: DataFrame, net: Prepared, boardings: int) -> list[DataFrame]:
    """For none to `boardings` more boardings: destination, end, stop_id and latest, the time by which one must be at a stop to reach a destination by a search's end.

    Found backwards from the destinations. Rules and waits of boarding are passed over, so no way that there is comes too late for its time; stops without any way aren't in it.
    """
    goals = searches.select(F.col("destination").cast(net.stop_type).alias("destination"), (F.col("departure") + F.col("horizon")).cast("long").alias("end")).distinct()
    walks = net.walks.groupBy(F.col("from_stop_id").alias("before"), F.col("to_stop_id").alias("stop_id")).agg(F.min("seconds").alias("seconds"))
    waits = net.rules.select("stop_id", F.expr("least(0, array_min(transform(rules, r -> r.wait)))").alias("wait"))  # a feed's mistake, if under zero

    def with_walks(times: DataFrame) -> DataFrame:
        back = times.join(walks, "stop_id").select("destination", "end", F.col("before").alias("stop_id"), (F.col("latest") - F.col("seconds")).alias("latest"))
        return times.unionByName(back).groupBy("destination", "end", "stop_id").agg(F.max("latest").alias("latest"))

    out = [kept(with_walks(goals.select("*", F.col("destination").alias("stop_id"), F.col("end").alias("latest"))), "latest")]
    for _ in range(boardings):
        off = net.later.join(out[-1], F.col("to_stop") == F.col("stop_id")).where("reached <= latest").groupBy("destination", "end", "trip_id").agg(F.max("position").alias("last"))
        on = off.join(net.boards, "trip_id").where("position <= last").groupBy("destination", "end", "stop_id").agg(F.max("departure").alias("latest"))
        on = on.join(waits, "stop_id", "left").select("destination", "end", "stop_id", (F.col("latest") - F.coalesce("wait", F.lit(0))).alias("latest"))
        out.append(kept(with_walks(on.unionByName(out[-1])), "latest"))
    return out


def rides(boarded: DataFrame, net: Prepared) -> DataFrame:
    """All later stops of what is boarded; of trips boarded for the window they open, those where they do."""
    return boarded.join(net.later, F.col("board_trip") == F.col("trip_id")).where("position >= board_position AND reached <= until AND (opens OR NOT only_opens)").drop("board_trip")

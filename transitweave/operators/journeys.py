"""Journeys by arrival, reliability and boardings, in rounds: one boarding a round, for many searches at once (told apart by query_id).

A label is a stop, an arrival, a cost and what it may board. Each round boards from the labels of
the one before, rides on and walks. A bag for each stop and state holds what all rounds have
reached; a label that the bag has something as good for, with no more boardings, goes no further. Labels
hold no paths: each ride is stored with the row of the ride before it, a table a round, and
only the journeys that win are followed back.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.gtfs import FLOOR, haversine_km
from .boarding import Prepared, boardings, latest_times, prepared, rides
from .keep import kept
from .reliability import Profiles
from .search import SearchLimit, pareto

_STATE = ["query_id", "stop_id", "held", "required_trip"]
_LABEL = ["query_id", "stop_id", "arrival", "cost", "last_trip", "held", "required_trip", "until", "ride", "trail"]


def undominated(labels: DataFrame, bag: DataFrame | None) -> DataFrame:
    """Of the labels of a state, those no other of which arrives as early and costs as little, with `new`: false for those of the bag.

    Of equal ones the bag's stays, then the first trail. held is a trip that transfer rules name; other trips don't
    tell states apart, as changing to the trip one has come by is never better than to stay on it.
    """
    both = labels.withColumn("new", F.lit(True))
    if bag is not None:
        both = both.unionByName(bag.withColumn("new", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*_STATE).orderBy("arrival", "cost", "new", "trail").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("least", F.min("cost").over(before)).where("least IS NULL OR cost < least - 1e-9").drop("least")


def _on_foot(labels: DataFrame, walks: DataFrame) -> DataFrame:
    """Labels and what they reach on foot; a walker holds no trip and must take the rule's trip, if it names one."""
    near = labels.join(walks, F.col("stop_id") == F.col("from_stop_id")).where("(from_trip_id IS NULL OR from_trip_id = last_trip) AND arrival + seconds <= until")
    none = F.lit(None).cast(labels.schema["last_trip"].dataType)
    return labels.unionByName(near.select("query_id", F.col("to_stop_id").alias("stop_id"), (F.col("arrival") + F.col("seconds")).alias("arrival"), "cost", none.alias("last_trip"), none.alias("held"), F.col("to_trip_id").alias("required_trip"), "until", "ride", "trail"))


def in_reach(labels: DataFrame, searches: DataFrame, places: DataFrame, speed: float) -> DataFrame:
    """Labels from which the destination can be reached in time at no more than `speed` metres a second, as the crow flies; a place that is not known bounds nothing."""
    place = lambda side: places.select(F.col("stop_id").alias(side), F.col("stop_lat").alias(f"{side}_lat"), F.col("stop_lon").alias(f"{side}_lon"))
    ends = searches.select("query_id", F.col("destination").alias("end")).join(place("end"), "end", "left").drop("end")
    here = labels.join(ends, "query_id").join(place("stop_id"), "stop_id", "left")
    seconds = F.floor(haversine_km(F.col("stop_id_lat"), F.col("stop_id_lon"), F.col("end_lat"), F.col("end_lon")) * 1000 / speed)
    return here.where(F.col("arrival") + F.coalesce(seconds, F.lit(0)) <= F.col("until")).select(*labels.columns)


def journeys(searches: DataFrame, hops: DataFrame, transfers: DataFrame, profiles: Profiles, max_transfers: int = 3, max_extra: int = 1800, **bounds) -> DataFrame:
    """As search, over a network that is prepared for these searches alone.

    hops: trip_id, stop_sequence, to_sequence, from_stop_id, to_stop_id, departure_seconds, arrival_seconds, pickup_type,
    drop_off_type, route_id, direction_id. transfers: from_stop_id, to_stop_id, transfer_type, min_transfer_time,
    from_trip_id, to_trip_id; rules of a stop with itself hold whenever a trip is boarded there.
    """
    return search(searches, _prepared_for(searches, hops, transfers, profiles), max_transfers, max_extra, **bounds)


def _prepared_for(searches: DataFrame, hops: DataFrame, transfers: DataFrame, profiles: Profiles, longer: int = 0) -> Prepared:
    """The network for these searches alone: only trips that can be boarded while any of them lasts, or `longer` seconds after."""
    horizon, earliest, latest = searches.agg(F.max("horizon"), F.min("departure"), F.max(F.col("departure") + F.col("horizon"))).first()
    return prepared(hops, transfers, profiles.kept(), horizon or 0, None if earliest is None or latest is None else (earliest, latest + longer))


def search(
    searches: DataFrame, net: Prepared, max_transfers: int = 3, max_extra: int = 1800, deadline_s: float | None = None,
    most_labels: int = 250_000, most_candidates: int = 10_000, places: DataFrame | None = None, speed: float | None = None,
) -> DataFrame:
    """query_id, arrival, cost, transfers, path, reliability: for each search its Pareto-best journeys.

    searches: query_id, origin, destination, departure, horizon (seconds after the departure). A passed
    deadline, or more labels in all rounds or more journeys at the destination than the bounds allow a search on
    average, raises SearchLimit: there are no partial results. With places (stop_id, stop_lat, stop_lon) and a speed
    that bounds all edges (see lookups.speed_bound) labels too far from their destination are dropped; without, none are.
    Of equal journeys one stays, the same in every run.

    For the later half of the boardings it is known from the other end by when a label must be where it is (latest_times). What comes
    later is dropped, also from the bag: whatever it dominates comes later still, with no more boardings left. So labels grow as
    the ways of half a search do and not with the network.
    """
    limit = time.monotonic() + deadline_s if deadline_s else None
    searches = kept(searches, "searches")
    asked, labels_seen, candidates_seen = searches.count(), 0, 0
    trip = lambda: F.lit(None).cast(net.trip_type)
    ends = searches.select("query_id", "destination")
    start = searches.select("query_id", F.col("origin").cast(net.stop_type).alias("stop_id"), F.col("departure").cast("long").alias("arrival"), F.lit(0.0).alias("cost"), trip().alias("last_trip"), trip().alias("held"), trip().alias("required_trip"), (F.col("departure") + F.col("horizon")).cast("long").alias("until"), F.lit(None).cast("long").alias("ride"), F.lit(0).cast("long").alias("trail"))

    goals = searches.select("query_id", F.col("destination").cast(net.stop_type).alias("destination"), (F.col("departure") + F.col("horizon")).cast("long").alias("end"))
    latest = latest_times(searches, net, (max_transfers + 1) // 2)

    def in_time(labels: DataFrame | None, left: int) -> DataFrame | None:
        """Labels from which `left` more boardings can lead to the destination in time, as far as that is known."""
        if labels is None or left >= len(latest):
            return labels
        return labels.join(goals, "query_id").join(latest[left], ["destination", "end", "stop_id"]).where("arrival <= latest").select(*labels.columns)

    def settled(labels: DataFrame, bag: DataFrame | None, left: int) -> tuple[DataFrame, DataFrame, int]:
        """The labels that go on, the bag with them, and how many they are; they are counted as they are written."""
        labels = in_time(labels, left)
        if places is not None and speed:
            labels = in_reach(labels, searches, places, speed)
        seen = Observation()
        both = kept(undominated(labels, bag).observe(seen, F.count_if("new").alias("n")), "bag")
        return both.where("new").drop("new"), both.drop("new"), seen.get["n"]

    stored: list[DataFrame] = []
    found: DataFrame | None = None
    frontier, _, n = settled(_on_foot(start, net.walks), None, max_transfers + 1)
    bag = None  # a place reached on foot alone is no journey's end, so it stands for none that a ride leads to
    for k in range(max_transfers + 1):
        if limit and time.monotonic() > limit:
            raise SearchLimit("the search passed its deadline")
        seen = Observation()
        left = max_transfers - k
        bag = in_time(bag, left)
        ridden = undominated(in_time(_ridden(frontier, net), left), bag).where("new").drop("new").join(ends, "query_id").withColumn("there", F.col("stop_id") == F.col("destination")).drop("destination")
        ridden = kept(ridden.withColumn("row", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("there").alias("there")), f"rides-{k}")
        stored.append(ridden)
        labels_seen, candidates_seen = labels_seen + n + seen.get["n"], candidates_seen + seen.get["there"]
        if labels_seen > most_labels * asked:
            raise SearchLimit("the search passed its number of labels")
        if candidates_seen > most_candidates * asked:
            raise SearchLimit("the search passed its number of journeys")
        at_end = lambda df: df.select("query_id", "arrival", "cost", F.lit(k).alias("transfers"), "ride", "trail")
        arrived = at_end(ridden.where("there").withColumn("ride", F.col("row")))
        found = arrived if found is None else found.unionByName(arrived)
        cutoff = found.groupBy("query_id").agg((F.min("arrival") + max_extra).alias("cutoff"))
        onward = ridden.where("NOT there").withColumn("ride", F.col("row")).join(cutoff, "query_id", "left").withColumn("until", F.least("until", "cutoff")).where("arrival <= until")
        frontier, bag, n = settled(_on_foot(onward.select(*_LABEL), net.walks), bag, left)
        found = found.unionByName(at_end(frontier.join(ends, "query_id").where("stop_id = destination AND last_trip IS NULL")))
        if not n:
            break
    last = found.groupBy("query_id").agg((F.min("arrival") + max_extra).alias("last"))
    rows = found.join(last, "query_id").where("arrival <= last").withColumn("cost", F.round("cost", 9))
    first = Window.partitionBy("query_id", "arrival", "cost", "transfers").orderBy("trail")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "trail", "last")
    return _followed_back(pareto(rows, ["query_id"]), stored).withColumn("reliability", F.exp(-F.col("cost")))


def _ridden(frontier: DataFrame, net: Prepared) -> DataFrame:
    """Labels after a ride, with the ride itself."""
    ridden = rides(boardings(frontier, net), net)
    return ridden.select(
        "query_id", F.col("to_stop").alias("stop_id"), F.col("reached").alias("arrival"), (F.col("cost") + F.col("leg_cost")).alias("cost"), F.col("trip_id").alias("last_trip"), F.when(F.col("named"), F.col("trip_id")).alias("held"),
        F.lit(None).cast(net.trip_type).alias("required_trip"), "until", "ride", F.xxhash64("trail", "trip_id", "from_sequence", "to_sequence").alias("trail"), "from_sequence", "to_sequence", F.col("stop_id").alias("from_stop"), "departure",
    )


def _followed_back(winners: DataFrame, stored: list[DataFrame]) -> DataFrame:
    """Winners with their path: rides of the last round are looked up, then the ones before them, one join a round."""
    leg = F.struct(F.col("last_trip").alias("trip_id"), "from_sequence", "to_sequence", "from_stop", F.col("stop_id").alias("to_stop"), "departure", "arrival")
    paths = None
    for k in reversed(range(len(stored))):
        table = stored[k].select(F.col("row").alias("ride"), F.col("ride").alias("before"), leg.alias("leg"))
        none = F.array().cast(f"array<{table.schema['leg'].dataType.simpleString()}>")
        own = winners.where(F.col("transfers") == k).withColumn("path", none)
        if paths is not None:
            own = own.unionByName(paths)
        paths = kept(own.join(table, "ride").withColumns({"path": F.concat(F.array("leg"), "path"), "ride": F.col("before")}).drop("before", "leg"), "paths")
    return paths.drop("ride")


def product_reliability(legs: DataFrame, keys: list[str]) -> DataFrame:
    """The product of the legs' probabilities, floored once; a leg without a profile counts as 0."""
    return legs.groupBy(*keys).agg(F.greatest(F.product(F.coalesce("reliability", F.lit(0.0))), F.lit(FLOOR)).alias("reliability"))


def legs_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row per leg, numbered from 0."""
    return found.select(*keys, F.posexplode("path").alias("position", "leg")).select(*keys, "position", "leg.*")


def merged_legs(rides: DataFrame, keys: list[str]) -> DataFrame:
    """Hops of a path (keys, position, trip_id, stop_sequence, from_stop_id, to_stop_id, departure, arrival) as legs: runs of one trip whose sequences grow."""
    w = Window.partitionBy(*keys).orderBy("position")
    new = F.coalesce((F.col("trip_id") != F.lag("trip_id").over(w)) | (F.col("stop_sequence") <= F.lag("stop_sequence").over(w)), F.lit(True))
    runs = rides.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    first, last = (lambda c: F.min_by(c, "position")), (lambda c: F.max_by(c, "position"))
    legs = runs.groupBy(*keys, (F.col("run") - 1).alias("leg"))
    return legs.agg(first("trip_id").alias("trip_id"), first("from_stop_id").alias("from_stop"), last("to_stop_id").alias("to_stop"), first("departure").alias("departure"), last("arrival").alias("arrival"), F.count(F.lit(1)).alias("hops"))


def leg_stops(legs: DataFrame, hops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, stop_sequence, stop_id, arrival, departure: all stops of each leg, by their own sequence."""
    on = legs.select(*keys, "position", "trip_id", "from_sequence", F.col("to_sequence").alias("last_sequence")).join(hops, "trip_id").where("stop_sequence BETWEEN from_sequence AND last_sequence")
    left = on.select(*keys, "position", "stop_sequence", F.col("from_stop_id").alias("stop_id"), F.lit(None).cast("long").alias("arrival"), F.col("departure_seconds").cast("long").alias("departure"))
    come = on.select(*keys, "position", F.col("to_sequence").alias("stop_sequence"), F.col("to_stop_id").alias("stop_id"), F.col("arrival_seconds").cast("long").alias("arrival"), F.lit(None).cast("long").alias("departure"))
    return left.unionByName(come).groupBy(*keys, "position", "stop_sequence", "stop_id").agg(F.max("arrival").alias("arrival"), F.max("departure").alias("departure"))


def itineraries(found: DataFrame) -> DataFrame:
    """Journeys as one nested row each, with times as text."""
    text = lambda c: f"concat_ws(':', lpad(cast({c} div 3600 as string), 2, '0'), lpad(cast({c} % 3600 div 60 as string), 2, '0'), lpad(cast({c} % 60 as string), 2, '0'))"
    legs = F.expr(f"transform(path, l -> named_struct('trip_id', l.trip_id, 'origin', l.from_stop, 'destination', l.to_stop, 'departure', {text('l.departure')}, 'arrival', {text('l.arrival')}))")
    return found.select("query_id", F.expr(text("arrival")).alias("arrival"), "transfers", "reliability", legs.alias("legs"))


def _leg_rules(leg, before) -> dict[str, Column]:
    """What is wrong with a leg, by itself and after the one before it; both are functions from names to columns."""
    return {
        "arrives before it departs": leg("arrival") < leg("departure"),
        "departs before the last leg arrives": leg("departure") < before("arrival"),
        "boards its own trip again": leg("trip_id") == before("trip_id"),
        "runs backwards": leg("to_sequence") < leg("from_sequence"),
    }


def path_violations(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Legs that break a rule, by rule: none for sound journeys."""
    w = Window.partitionBy(*keys).orderBy("position")
    rows = legs.withColumn("before", F.lag("arrival").over(w)).withColumn("trip_before", F.lag("trip_id").over(w))
    rules = _leg_rules(F.col, lambda c: F.col({"arrival": "before", "trip_id": "trip_before"}[c]))
    return rows.select(*keys, F.explode(F.array(*(F.when(c, k) for k, c in rules.items()))).alias("rule")).where("rule IS NOT NULL")


def next_rides(waiting: DataFrame, rides: DataFrame, within: int) -> DataFrame:
    """waiting with `ride`: the first, by departure, trip and sequence, that leaves its stop by another trip no later than `within` seconds after; null if none does.

    waiting: stop_id, arrival, trip_id and others. rides: stop_id and ride, a struct that holds departure, trip_id and sequence first.
    Both stand in one order of time at each stop, so no pairs are made: a ride knows the next one of another trip, and who waits the next ride.
    """
    label, time, trip = F.struct(*waiting.columns), F.coalesce("ride.departure", "label.arrival"), "ride.trip_id"
    both = waiting.select("stop_id", label.alias("label")).unionByName(rides.select("stop_id", "ride"), allowMissingColumns=True).withColumns({"time": time, "waits": F.col("label").isNotNull()})
    back = Window.partitionBy("stop_id").orderBy(F.desc("time"), F.asc("waits"), F.desc("ride"))  # from the last to the first; who waits comes after the rides of that second
    other = F.expr(f"lead({trip}) IGNORE NULLS OVER (PARTITION BY stop_id ORDER BY time DESC, waits ASC, ride DESC) <> {trip}")
    rows = both.withColumn("other", other).withColumn("second", F.last(F.when(F.col("other"), F.col("ride")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("near", F.last(F.when(~F.col("waits"), F.struct("ride", "second")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("waits")
    rows = rows.withColumn("next", F.when(F.col("near.ride.trip_id") != F.col("label.trip_id"), F.col("near.ride")).otherwise(F.col("near.second")))
    return rows.select("label.*", F.when(F.col("next.departure") <= F.col("label.arrival") + within, F.col("next")).alias("ride"))


def chain_violations(chains: DataFrame, asked: DataFrame, hops: DataFrame, transfers: DataFrame) -> DataFrame:
    """chain_id, position, rule: what is wrong with chains of labels, one row each.

    chains: chain_id, position, kind (start, ride of one hop, or walk), stop_id, departure (of a ride), arrival, trip_id, can_alight,
    transfers, cost. asked: chain_id, origin, destination, departure. hops need leg_cost, transfers from_trip_id and to_trip_id.
    A walker keeps the trip by which they have come. Each label is judged by the one before it, so all chains are judged
    at once, in windows of a chain's length. These are the only ones that move whole labels: the result is kept, and of it rides
    go to the hops, walks to the ways on foot and changes to the stops' rules, each with the columns that they need.
    """
    way = Window.partitionBy("chain_id").orderBy("position")
    before = lambda c: F.lag(c).over(way)
    rows = chains.withColumns({f"p_{c}": before(c) for c in ("stop_id", "arrival", "trip_id", "can_alight", "cost")} | {"first": before("position").isNull(), "last": F.lead("position").over(way).isNull()})
    ride, walk = F.col("kind") == "ride", F.col("kind") == "walk"
    boards = ride & ~F.col("trip_id").eqNullSafe(F.col("p_trip_id"))
    changes = F.coalesce(boards & F.col("p_trip_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("changes", changes).withColumn("counted", F.sum(F.col("changes").cast("int")).over(way)).withColumn("boards", F.coalesce(boards, F.lit(False)))
    rows = rows.withColumn("aboard", F.last(F.when(F.col("boards"), F.col("p_cost")), ignorenulls=True).over(way))
    rows = rows.join(asked.select("chain_id", "origin", "destination", F.col("departure").alias("asked")), "chain_id")
    alone = {
        "begins elsewhere": F.col("first") & ((F.col("stop_id") != F.col("origin")) | (F.col("arrival") != F.col("asked"))),
        "ends elsewhere": F.col("last") & ((F.col("stop_id") != F.col("destination")) | ~F.col("can_alight")),
        "goes back in time": F.col("arrival") < F.col("p_arrival"),
        "leaves before it has come": ride & (F.col("departure") < F.col("p_arrival")),
        "walks from where none gets off": walk & ~F.col("p_can_alight"),
        "changes where none gets off": F.col("changes") & ~F.col("p_can_alight"),
        "another number of changes": F.col("transfers") != F.col("counted"),
        "another cost": ~ride & (F.abs(F.col("cost") - F.when(walk, F.col("p_cost")).otherwise(F.lit(0.0))) > 1e-6),
    }
    broken = lambda rules: F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))
    judged = kept(rows.select("chain_id", "position", "kind", "p_stop_id", "stop_id", "departure", "p_arrival", "arrival", "p_trip_id", "trip_id", "can_alight", "changes", "boards", (F.col("cost") - F.col("aboard")).alias("paid"), broken(alone).alias("broken")), "judged")

    def found(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        return rows.select("chain_id", "position", F.explode(broken(rules)).alias("rule"))

    real = hops.select("trip_id", F.col("from_stop_id").alias("p_stop_id"), F.col("to_stop_id").alias("stop_id"), F.col("departure_seconds").alias("departure"), F.col("arrival_seconds").alias("h_arrival"), "pickup_type", "drop_off_type", "leg_cost", F.lit(True).alias("real"))
    rides = judged.where(ride).select("chain_id", "position", "trip_id", "p_stop_id", "stop_id", "departure", "arrival", "can_alight", "boards", "paid").join(real, ["trip_id", "p_stop_id", "stop_id", "departure"], "left")
    of_rides = {
        "a ride that there is not": F.col("real").isNull(),
        "arrives at another time": F.col("real") & (F.col("arrival") != F.col("h_arrival")),
        "boards without a pickup": F.col("real") & F.col("boards") & (F.col("pickup_type") != 0),
        "gets off wrongly": F.col("real") & (F.col("can_alight") != (F.col("drop_off_type") == 0)),
        "another cost": F.abs(F.col("paid") - F.col("leg_cost")) > 1e-6,
    }
    between = transfers.where("from_stop_id <> to_stop_id AND transfer_type <> 3").groupBy(F.col("from_stop_id").alias("p_stop_id"), F.col("to_stop_id").alias("stop_id")).agg(F.collect_set(F.coalesce("min_transfer_time", F.lit(0)).cast("long")).alias("seconds"))
    walks = judged.where(walk).select("chain_id", "position", "p_stop_id", "stop_id", (F.col("arrival") - F.col("p_arrival")).alias("took")).join(between, ["p_stop_id", "stop_id"], "left")
    of_walks = {"a walk that there is not": F.col("seconds").isNull(), "a walk of another length": ~F.array_contains("seconds", F.col("took"))}
    few = F.collect_set(F.struct("from_trip_id", "to_trip_id", "transfer_type", F.coalesce("min_transfer_time", F.lit(0)).alias("wait")))
    own = transfers.where("from_stop_id = to_stop_id").groupBy(F.col("from_stop_id").alias("p_stop_id")).agg(few.alias("rules"))
    changed = judged.where("changes").select("chain_id", "position", "p_stop_id", "p_trip_id", "trip_id", "departure", "p_arrival").join(own, "p_stop_id")
    changed = changed.withColumn("rules", F.expr("filter(rules, r -> (r.from_trip_id IS NULL OR r.from_trip_id = p_trip_id) AND (r.to_trip_id IS NULL OR r.to_trip_id = trip_id))"))
    of_changes = {"changes against a rule": F.expr("exists(rules, r -> r.transfer_type = 3) OR departure < p_arrival + array_max(transform(rules, r -> r.wait))")}
    return judged.select("chain_id", "position", F.explode("broken").alias("rule")).unionByName(found(rides, of_rides)).unionByName(found(walks, of_walks)).unionByName(found(changed, of_changes))


def itinerary_violations(asked: DataFrame, found: DataFrame, real: DataFrame) -> DataFrame:
    """query_id, rule: what is wrong with the journeys found for searches, each rule once a search.

    asked: query_id, origin, destination, departure. found: query_id, origin, destination, departure,
    arrival, transfers, duration, path. real: trip_id, from_stop, to_stop, departure, arrival of all rides
    that there are.
    """
    a = asked.select("query_id", F.col("origin").alias("a_origin"), F.col("destination").alias("a_destination"), F.col("departure").alias("a_departure"))
    rows = kept(a.join(found.withColumn("found", F.lit(True)), "query_id", "left"), "asked-and-found")
    legs = F.coalesce(F.size("path"), F.lit(0))
    first, last = F.try_element_at("path", F.lit(1)), F.try_element_at("path", F.lit(-1))
    rules = {
        "nothing was found": F.col("found").isNull(),
        "another origin": F.col("origin") != F.col("a_origin"),
        "another destination": F.col("destination") != F.col("a_destination"),
        "another departure": F.col("departure") != F.col("a_departure"),
        "arrives before the departure asked for": F.col("arrival") < F.col("a_departure"),
        "no legs": F.col("found").isNotNull() & (legs == 0),
        "departs before the departure asked for": first["departure"] < F.col("a_departure"),
        "does not end at the destination": (legs > 0) & (last["to_stop"] != F.col("a_destination")) & (last["arrival"] == F.col("arrival")),
        "a wrong number of transfers": F.col("transfers") != F.greatest(F.lit(0), legs - 1),
        "a wrong duration": F.col("duration") != F.col("arrival") - F.col("departure"),
    }
    of_legs = F.transform("path", lambda leg, k: F.array(*(F.when(c, rule) for rule, c in _leg_rules(leg.getField, F.get("path", k - 1).getField).items())))
    broken = F.array_distinct(F.concat(F.array(*(F.when(c, k) for k, c in rules.items())), F.coalesce(F.flatten(of_legs), F.array().cast("array<string>"))))
    whole = rows.select("query_id", F.explode(broken).alias("rule")).where("rule IS NOT NULL")
    single = rows.where("found").select("query_id", F.explode("path").alias("leg")).select("query_id", "leg.*")
    unreal = single.join(real.select("trip_id", "from_stop", "to_stop", "departure", "arrival"), ["trip_id", "from_stop", "to_stop", "departure", "arrival"], "left_anti").select("query_id", F.lit("a ride that there is not").alias("rule"))
    return whole.unionByName(unreal).distinct()


def earliest(searches: DataFrame, net: Prepared, max_transfers: int = 3, **bounds) -> DataFrame:
    """Of each search the journey that arrives first; of those with the fewest transfers, the most reliable, the first path."""
    w = Window.partitionBy("query_id").orderBy("arrival", "transfers", "cost", "path")
    return search(searches, net, max_transfers, max_extra=0, **bounds).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def candidates(searches: DataFrame, hops: DataFrame, transfers: DataFrame, profiles: Profiles, limit: int = 5, max_extra: int = 1800, max_transfers: int = 3, **bounds) -> DataFrame:
    """query_id, attempt, arrival, cost, transfers, path: earliest journeys one after another, each asked a second after the last one's first boarding.

    All searches go on together, over a network prepared once. One ends with `limit` different journeys, after 4 x limit
    attempts, without a journey, or with one over max_extra seconds later than its first.
    """
    if limit < 1 or max_extra < 0:
        raise ValueError("a limit of 1 or more and no negative extra time")
    # What arrives later than max_extra after the first journey, which ends within its horizon, doesn't count.
    net = _prepared_for(searches, hops, transfers, profiles, longer=max_extra)
    ask, out = searches, None
    identity = F.transform("path", lambda leg: F.struct(leg["trip_id"], leg["from_stop"], leg["to_stop"])).cast("string")
    for attempt in range(limit * 4):
        new = earliest(ask, net, max_transfers, **bounds).withColumn("attempt", F.lit(attempt)).withColumn("same", identity)
        if out is not None:
            fastest = out.groupBy("query_id").agg(F.min_by("arrival", "attempt").alias("fastest"))
            new = new.join(fastest, "query_id").where(F.col("arrival") <= F.col("fastest") + max_extra).drop("fastest")
        new = kept(new, "candidates")
        if new.isEmpty() and out is not None:
            break
        out = kept(new if out is None else out.unionByName(new), "candidates")
        enough = out.groupBy("query_id").agg(F.countDistinct("same").alias("n")).where(F.col("n") >= limit).select("query_id")
        again = new.where("size(path) > 0").select("query_id", (F.element_at("path", 1)["departure"] + 1).alias("next")).join(enough, "query_id", "left_anti")
        ask = kept(ask.join(again, "query_id").where("next > departure").withColumn("departure", F.col("next")).drop("next"), "searches")
        if ask.isEmpty():
            break
    return out.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "same").orderBy("attempt"))).where("k = 1").drop("k", "same")

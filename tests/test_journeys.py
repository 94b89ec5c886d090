import random
from math import exp, log

import pytest
from pyspark.sql import functions as F

from transitweave.operators import boarding
from transitweave.operators import journeys as jo
from transitweave.operators.keep import kept
from transitweave.operators.reliability import Profiles
from transitweave.operators.search import SearchLimit
from transitweave.plans.requests import JourneyRequest, answered

HOPS = "trip_id long, stop_sequence long, to_sequence long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, pickup_type int, drop_off_type int, route_id long, direction_id int"
RULES = "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int, from_trip_id long, to_trip_id long"
SAMPLES = "trip_id long, service_date string, route_id long, direction_id int, time_window string, delay double"
ASK = "query_id int, origin long, destination long, departure long, horizon long"


def network(seed):
    rng = random.Random(seed)
    hops = []
    for trip in range(14):
        at, t = rng.randrange(7), 28800 + rng.randrange(0, 3000, 60)
        for k in range(rng.randrange(1, 4)):
            to = rng.choice([s for s in range(7) if s != at])
            arrival = t + rng.randrange(300, 900, 60)
            hops.append((trip, k + 1, k + 2, at, to, t, arrival, int(rng.random() < 0.1), int(rng.random() < 0.1), trip % 4, 0))
            at, t = to, arrival + 60
    walks = [(0, 1, 2, 120, None, None), (1, 2, 2, 60, None, None), (3, 3, 2, 180, None, None), (4, 4, 3, None, None, None), (2, 5, 3, None, None, None), (5, 6, 2, 90, 3, None), (2, 2, 2, 240, None, 5)]
    share = {r: rng.choice([0.25, 0.5, 0.75, 1.0]) for r in range(3)}  # route 3 has no profile of its own
    samples = [(1, "d", r, 0, "morning_peak", 0.0 if k < 40 * p else 900.0) for r, p in share.items() for k in range(40)]
    return hops, walks, samples


def all_journeys(hops, rules, chance, origin, destination, at, until, boardings):
    """Every way within the bounds: (arrival, cost, boardings)."""
    found = set()

    def walk(stop, t, cost, last, used, seen):
        """Ways on foot from a place, itself included: stop, time, trip held, trip required."""
        yield stop, t, last, None
        for a, b, kind, least, own, then in rules:
            if a == stop and b != stop and kind != 3 and b not in seen and (own is None or own == last) and t + (least or 0) <= until:
                for x in walk(b, t + (least or 0), cost, None, used, seen | {b}):
                    yield x if x[3] or x[0] != b or x[2] is not None else (*x[:3], then if x[0] == b and x[1] == t + (least or 0) else x[3])

    def go(stop, t, cost, last, used):
        for s, now, held, required in walk(stop, t, cost, last, used, {stop}):
            if s == destination and used and (held is None or s == stop):
                found.add((now, round(cost, 9), used - 1))
            if used == boardings or (s == destination and used):
                continue
            for k, h in enumerate(hops):
                trip = h[0]
                mine = [r for r in rules if r[0] == r[1] == s and (r[4] is None or r[4] == held) and (r[5] is None or r[5] == trip)]
                if h[3] != s or h[7] == 1 or h[8] == 1 or trip == held or required not in (None, trip) or any(r[2] == 3 for r in mine):
                    continue
                if h[5] < now + max((r[3] or 0 for r in mine), default=0) or h[5] > until:
                    continue
                for x in hops[k:]:
                    if x[0] == trip and x[6] <= until:
                        go(x[4], x[6], cost - log(max(1e-9, chance(x[9], x[6]))), trip, used + 1)

    go(origin, at, 0.0, None, 0)
    return found


def pareto(ways):
    return {a for a in ways if not any(b != a and b[0] <= a[0] and b[1] <= a[1] + 1e-9 and b[2] <= a[2] for b in ways)}


def lines(seed):
    """Lines of several trips, some of which pass others, around ten o'clock, when the window of the day changes; one stop is called at twice."""
    rng = random.Random(seed)
    hops, trip = [], 100
    for route, stops in enumerate(([0, 1, 2, 3, 4], [5, 1, 3, 6], [0, 2, 0, 5, 6])):
        for _ in range(rng.randrange(3, 7)):
            t, boards = 34200 + rng.randrange(0, 3600, 120), [int(rng.random() < 0.1) for _ in stops]
            for k, (at, to) in enumerate(zip(stops, stops[1:], strict=False)):
                arrival = t + rng.choice([180, 300, 900])
                hops.append((trip, k + 1, k + 2, at, to, t, arrival, boards[k] if trip % 3 else 0, 0, route, 0))
                t = arrival + 60
            trip += 1
    walks = [(1, 2, 2, 120, None, None), (4, 3, 2, 60, None, None), (3, 3, 2, 240, None, None), (2, 2, 2, 600, 103, None)]
    share = {(r, w): rng.choice([0.25, 0.5, 0.75, 1.0]) for r in range(3) for w in ("morning_peak", "midday")}
    samples = [(1, "d", r, 0, w, 0.0 if k < 40 * p else 900.0) for (r, w), p in share.items() for k in range(40)]
    return hops, walks, samples


def moved(seed, network):
    """A network whose stops, trips and routes no other has, so that all are searched together."""
    hops, walks, samples = network
    stop, trip = (lambda x: x if x is None else x + 1000 * seed), (lambda x: x if x is None else x + 100_000 * seed)
    hops = [(trip(h[0]), h[1], h[2], stop(h[3]), stop(h[4]), *h[5:9], stop(h[9]), h[10]) for h in hops]
    return hops, [(stop(w[0]), stop(w[1]), w[2], w[3], trip(w[4]), trip(w[5])) for w in walks], [(s[0], s[1], stop(s[2]), *s[3:]) for s in samples]


def test_journeys_against_all_ways(spark):
    """Over 24 random networks: the same journeys as all ways give, and paths that can be ridden."""
    made = {seed: (moved(seed, network(seed)), 28800, 7200) for seed in range(12)} | {seed: (moved(seed, lines(seed)), 34200, 5400) for seed in range(12, 24)}
    hops, rules, samples = (sum((m[0][k] for m in made.values()), []) for k in range(3))
    profiles = Profiles(spark.createDataFrame(samples, SAMPLES)).kept()
    exact = {(r.route_id, r.time_window): r.reliability for r in profiles.exact().collect()}
    fallback = profiles.network().first().reliability
    route = {r.route_id: r.reliability for r in profiles.route().collect()}
    chance = lambda r, t: exact.get((r, "morning_peak" if t < 36000 else "midday"), route.get(r, fallback))
    asked = [(len(made) * k + seed, 1000 * seed + a, 1000 * seed + b, start, horizon) for seed, (_, start, horizon) in made.items() for k, (a, b) in enumerate([(0, 4), (0, 6), (3, 1), (5, 2), (1, 3), (2, 6), (1, 2), (0, 2)])]
    ask, h, r = spark.createDataFrame(asked, ASK), spark.createDataFrame(hops, HOPS), spark.createDataFrame(rules, RULES)
    found = kept(jo.journeys(ask, h, r, profiles, max_transfers=2, max_extra=7200))
    rows, some = found.collect(), 0
    for query, a, b, start, horizon in asked:
        (own, walks, _), *_ = made[query % len(made)]
        want = pareto(all_journeys(own, walks, chance, a, b, start, start + horizon, 3))
        got = {(x.arrival, round(x.cost, 9), x.transfers) for x in rows if x.query_id == query}
        assert {(t, n, round(c, 6)) for t, c, n in got} == {(t, n, round(c, 6)) for t, c, n in want}, (query % len(made), a, b)
        some += len(want)
    assert some > 100 and all(abs(x.reliability - exp(-x.cost)) < 1e-9 and len(x.path) == x.transfers + 1 for x in rows)
    legs = jo.legs_of(found.withColumnRenamed("arrival", "end"), ["query_id", "end", "cost"])
    assert jo.path_violations(legs, ["query_id", "end", "cost"]).count() == 0
    # each leg is a ride of its trip between these calls
    at, to = {(x[0], x[1]): (x[3], x[5]) for x in hops}, {(x[0], x[1]): (x[4], x[6]) for x in hops}
    assert all(at[leg.trip_id, leg.from_sequence] == (leg.from_stop, leg.departure) and to[leg.trip_id, leg.to_sequence] == (leg.to_stop, leg.arrival) for leg in legs.collect())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, jo.journeys(ask.repartition(3), h.repartition(5), r, profiles, max_transfers=2, max_extra=7200).collect()))


def test_a_label_boards_one_trip_of_a_chain(spark):
    """Sixty trips of one line, two of which pass others: after a ride there is a label a stop and window, where all later trips would give sixty."""
    hops = [(k, i + 1, i + 2, i, i + 1, 30000 + 60 * k + 300 * i, 30000 + 60 * k + 300 * i + 240 - 150 * (k in (20, 40)), 0, 0, 1, 0) for k in range(60) for i in range(5)]
    hops = [h if h[0] not in (20, 40) else (*h[:5], h[5] - 60 * h[1], h[6] - 60 * h[1], *h[7:]) for h in hops]
    samples = [(1, "d", 1, 0, w, 0.0) for w in ("morning_peak", "midday") for _ in range(5)]
    net = boarding.prepared(spark.createDataFrame(hops, HOPS), spark.createDataFrame([], RULES), Profiles(spark.createDataFrame(samples, SAMPLES)).kept(), 7200)
    chains = boarding.chains(boarding.calls_of_patterns(spark.createDataFrame(hops, HOPS)))
    assert chains.agg(F.countDistinct("level")).first()[0] == 2
    label = spark.createDataFrame([(1, 0, 30000, 37200, None, None)], "query_id int, stop_id long, arrival long, until long, last_trip long, required_trip long").withColumns({"cost": F.lit(0.0), "ride": F.lit(None).cast("long"), "trail": F.lit(0).cast("long")})
    first = boarding.boardings(label, net).where("NOT only_opens").select("board_trip").collect()
    assert len(first) == 2 and {r.board_trip for r in first} >= {0}
    assert boarding.rides(boarding.boardings(label, net), net).count() < 60 * 5 / 4


def test_a_loop_ends(spark):
    """Trips in a circle: nothing that an earlier round dominates goes on, so later rounds have no labels."""
    hops = [(10 * k + i, 1, 2, i, (i + 1) % 4, 28800 + 600 * k + 120 * i, 28860 + 600 * k + 120 * i, 0, 0, 1, 0) for k in range(6) for i in range(4)]
    samples = [(1, "d", 1, 0, "morning_peak", 0.0) for _ in range(5)]
    ask = spark.createDataFrame([(1, 0, 3, 28800, 5400)], ASK)
    found = jo.journeys(ask, spark.createDataFrame(hops, HOPS), spark.createDataFrame([], RULES), Profiles(spark.createDataFrame(samples, SAMPLES)), max_transfers=8, max_extra=5400, most_labels=40)
    assert [(r.arrival, r.transfers, [leg.trip_id for leg in r.path]) for r in found.collect()] == [(29100 + 0, 2, [0, 1, 2])]


def test_labels_that_lead_nowhere_are_dropped(spark):
    """Of 30 x 30 ways one leads on to the destination, with four boardings: labels of the later half are those of that way, so the search stays under its bound, and a late trip to the destination brings none back."""
    hops = [(100 + a, 1, 2, 0, a, 28800, 29100, 0, 0, 1, 0) for a in range(1, 31)]
    hops += [(1000 * a + b, 1, 2, a, 100 * a + b, 29400, 29700, 0, 0, 1, 0) for a in range(1, 31) for b in range(30)]
    hops += [(90001, 1, 2, 703, 8000, 30000, 30300, 0, 0, 1, 0), (90002, 1, 2, 8001, 9000, 30600, 30900, 0, 0, 1, 0), (90003, 1, 2, 805, 9000, 37000, 37100, 0, 0, 1, 0)]
    rules = spark.createDataFrame([(8000, 8001, 2, 120, None, None), (703, 703, 2, 300, None, None)], RULES)
    profiles = Profiles(spark.createDataFrame([(1, "d", 1, 0, "morning_peak", 0.0) for _ in range(5)], SAMPLES)).kept()
    ask = spark.createDataFrame([(1, 0, 9000, 28800, 7200)], ASK)
    net = boarding.prepared(spark.createDataFrame(hops, HOPS), rules, profiles, 7200)
    found = jo.search(ask, net, most_labels=100).collect()
    assert [(r.arrival, r.transfers, [leg.trip_id for leg in r.path]) for r in found] == [(30900, 3, [107, 7003, 90001, 90002])]
    times = [{r.stop_id: r.latest for r in t.collect()} for t in boarding.latest_times(ask, net, 2)]
    assert times == [{9000: 36000}, {9000: 36000, 8001: 30600, 8000: 30480}, {9000: 36000, 8001: 30600, 8000: 30480, 703: 30000}]


def test_search_limits(spark):
    hops, rules, profiles = simple(spark)
    ask = spark.createDataFrame([(1, 1, 3, 28700, 10800)], ASK)
    for bound in ({"most_labels": 2}, {"most_candidates": 0}, {"deadline_s": 1e-9}):
        with pytest.raises(SearchLimit):
            jo.journeys(ask, hops, rules, profiles, max_extra=7200, **bound)


def test_speed_bound_drops_labels_alone(spark):
    """The same journeys with and without the bound; with it, the way that leads off the straight line isn't followed."""
    hops = [(1, 1, 2, 1, 2, 28800, 29400, 0, 0, 1, 0), (2, 1, 2, 2, 3, 29500, 30000, 0, 0, 1, 0), (3, 1, 2, 1, 9, 28800, 32400, 0, 0, 1, 0), (4, 1, 2, 9, 3, 33000, 36600, 0, 0, 1, 0)]
    places = spark.createDataFrame([(1, 49.0, -123.0), (2, 49.05, -123.0), (3, 49.1, -123.0), (9, 49.6, -123.0)], "stop_id long, stop_lat double, stop_lon double")
    net = boarding.prepared(spark.createDataFrame(hops, HOPS), spark.createDataFrame([], RULES), Profiles(spark.createDataFrame([(1, "d", 1, 0, "morning_peak", 0.0)], SAMPLES)).kept(), 10800)
    ask = spark.createDataFrame([(1, 1, 3, 28800, 7200)], ASK)
    with_bound, without = jo.search(ask, net, max_extra=1800, places=places, speed=20.0), jo.search(ask, net, max_extra=1800)
    assert with_bound.drop("path").collect() == without.drop("path").collect() and with_bound.count() == 1
    labels = spark.createDataFrame([(1, 2, 29400, 36000), (1, 9, 32400, 36000), (1, 7, 30000, 36000)], "query_id int, stop_id long, arrival long, until long")
    assert {r.stop_id for r in jo.in_reach(labels, ask, places, 15.0).collect()} == {2, 7}


def simple(spark):
    hops = [(1, 1, 2, 1, 2, 28800, 29400, 0, 0, 1, 0), (1, 2, 3, 2, 3, 29460, 30000, 0, 0, 1, 0), (2, 1, 2, 1, 3, 29700, 30300, 0, 0, 2, 0), (3, 1, 2, 1, 3, 33000, 34000, 0, 0, 2, 0)]
    samples = [(1, "d", r, 0, "morning_peak", 0.0) for r in (1, 2) for _ in range(5)]
    return spark.createDataFrame(hops, HOPS), spark.createDataFrame([], RULES), Profiles(spark.createDataFrame(samples, SAMPLES))


def test_candidates_and_validation(spark):
    hops, rules, profiles = simple(spark)
    ask = spark.createDataFrame([(1, 1, 3, 28700, 10800), (2, 3, 1, 28700, 10800)], ASK)
    found = jo.candidates(ask, hops, rules, profiles, limit=5, max_extra=1800, max_transfers=1)
    assert [(r.query_id, r.attempt, r.arrival, [leg.trip_id for leg in r.path]) for r in found.orderBy("attempt").collect()] == [(1, 0, 30000, [1]), (1, 1, 30300, [2])]
    with pytest.raises(ValueError):
        jo.candidates(ask, hops, rules, profiles, limit=0)
    real = spark.createDataFrame([(1, 1, 3, 28800, 30000)], "trip_id long, from_stop long, to_stop long, departure long, arrival long")
    best = jo.earliest(ask, boarding.prepared(hops, rules, profiles.kept(), 10800), 1).join(ask, "query_id").withColumn("duration", F.col("arrival") - F.col("departure")).withColumn("origin", F.col("origin"))
    assert {(r.query_id, r.rule) for r in jo.itinerary_violations(ask, best, real).collect()} == {(2, "nothing was found")}
    bad = best.withColumns({"transfers": F.lit(4), "duration": F.lit(1).cast("long"), "origin": F.lit(9).cast("long"), "departure": F.lit(28900).cast("long")})
    rules_broken = {r.rule for r in jo.itinerary_violations(ask, bad, real.where("false")).collect() if r.query_id == 1}
    assert rules_broken == {"a wrong number of transfers", "a wrong duration", "another origin", "another departure", "a ride that there is not"}


def test_requests(spark):
    hops, rules, profiles = simple(spark)
    stops = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "stop_id long, stop_name string")
    asked = [JourneyRequest(1, 3, "7:55:00", include_alternatives=True, timeout_seconds=120.0), JourneyRequest(1, 3, " 07:55:00 ", algorithm="dijkstra", timeout_seconds=120.0)]
    rows = {(r.query_id, r["rank"]): r for r in answered(spark, asked, hops, rules, stops, profiles).collect()}
    assert rows[0, 1].arrival == 30000 and (1, 1) in rows and (1, 2) not in rows
    leg = rows[1, 1].legs[0]
    assert [s.stop_name for s in leg.stops] == ["One", "Two", "Three"] and leg.stops[1].arrival == 29400 and leg.stops[1].departure == 29460 and leg.duration == 1200
    for bad in ({"origin": " "}, {"destination": 1}, {"departure_time": "8:60:00"}, {"algorithm": "x"}, {"max_extra_minutes": 121}, {"timeout_seconds": 0}, {"reliability_effect": 0, "travel_time_effect": 0}, {"transfer_effect": -1.0}, {"limit": 0}, {"minimum_samples": 0}):
        with pytest.raises(ValueError):
            JourneyRequest(**({"origin": 1, "destination": 3, "departure_time": "8:00:00"} | bad))


def test_requests_by_text_ids(spark):
    """Stops and trips named by text; answers have their algorithm, and say where profiles are thin."""
    hops, rules, profiles = simple(spark)
    text = {c: F.concat(F.lit("T" if c == "trip_id" else "S"), F.col(c)) for c in ("trip_id", "from_stop_id", "to_stop_id")}
    ruled = rules.withColumns({c: F.col(c).cast("string") for c in ("from_stop_id", "to_stop_id", "from_trip_id", "to_trip_id")})
    stops = spark.createDataFrame([("S1", "One"), ("S3", "Three")], "stop_id string, stop_name string")
    asked = [JourneyRequest("S1", "S3", "7:55:00", algorithm="AStar", timeout_seconds=120.0), JourneyRequest(" S1 ", "S3", "7:55:00", minimum_samples=5, timeout_seconds=120.0), JourneyRequest("S3", "S1", "7:55:00", timeout_seconds=120.0)]
    rows = {r.query_id: r for r in answered(spark, asked, hops.withColumns(text), ruled, stops, profiles).collect()}
    assert {k: (r.algorithm, r.arrival, r.insufficient) for k, r in rows.items()} == {0: ("astar", 30000, True), 1: ("mc_raptor", 30000, False)}
    leg = rows[0].legs[0]
    assert (leg.trip_id, leg.from_stop, leg.to_stop, leg.level, leg.samples, [s.stop_name for s in leg.stops]) == ("T1", "S1", "S3", "exact", 5, ["One", None, "Three"])
    with pytest.raises(ValueError):
        answered(spark, [JourneyRequest("S1", "S3", "7:55:00")], hops, rules, stops, profiles)
    with pytest.raises(ValueError):
        answered(spark, [], hops, rules, stops, profiles)


def test_product_of_legs(spark):
    legs = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None), (2, 0.9), (3, 1e-7), (3, 1e-7)], "k int, reliability double")
    assert {r.k: r.reliability for r in jo.product_reliability(legs, ["k"]).collect()} == {1: 0.25, 2: 1e-9, 3: 1e-9}


def test_only_trips_in_time_are_prepared(spark):
    """Of trips all day long, those that can be boarded while a search lasts are prepared; journeys are those over the whole network."""
    hops = [(100 * h + k, i + 1, i + 2, i, i + 1, 3600 * h + 120 * k + 600 * i, 3600 * h + 120 * k + 600 * i + 500, 0, 0, k % 2, 0) for h in range(24) for k in range(4) for i in range(4)]
    samples = [(1, "d", r, 0, w, 0.0 if k < 20 else 900.0) for r in (0, 1) for w in ("morning_peak", "midday") for k in range(20 + 10 * r)]
    h, rules, profiles = spark.createDataFrame(hops, HOPS), spark.createDataFrame([], RULES), Profiles(spark.createDataFrame(samples, SAMPLES)).kept()
    ask = spark.createDataFrame([(1, 0, 4, 28800, 5400), (2, 1, 3, 30600, 5400)], ASK)
    net = jo._prepared_for(ask, h, rules, profiles)
    assert {r.trip_id // 100 for r in net.later.select("trip_id").distinct().collect()} <= {7, 8, 9, 10}
    assert 0 < net.catch.count() < boarding.prepared(h, rules, profiles, 5400).catch.count() / 8
    whole = jo.search(ask, boarding.prepared(h, rules, profiles, 5400)).collect()
    assert whole and sorted(map(tuple, whole)) == sorted(map(tuple, jo.journeys(ask, h, rules, profiles).collect()))

"""How much is moved, at sizes where it tells."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from transitweave.operators import calendar as cal
from transitweave.operators import journeys, keep, search


@contextmanager
def unbroadcast(spark):
    """Joins by shuffles, as of large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffled(spark, act):
    """Rows written to shuffles while act() runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = rows()
    act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in rows().items() if k not in before)


def test_services_of_many_trips(spark):
    """Trips are reduced to their services before any join: five services of 20,000 trips are few rows."""
    calendar = spark.createDataFrame([("s0", "1111111", "2026-01-01", "2026-12-31"), ("s1", "0000000", "2026-01-01", "2026-12-31")], "service_id string, days string, start_date string, end_date string")
    none = spark.createDataFrame([], "service_id string, service_date date, exception_type int")
    trips, found = spark.range(20_000, numPartitions=8).select(F.concat(F.lit("s"), F.col("id") % 5).alias("service_id")), []
    with unbroadcast(spark):
        n = shuffled(spark, lambda: found.extend(cal.active_or_unruled(trips, calendar, none, "2026-07-26").collect()))
    assert sorted(r.service_id for r in found) == ["s0", "s2", "s3", "s4"] and n < 500


def test_next_rides_without_pairs(spark):
    """A busy stop: each of 400 who wait gets the first ride of another trip, as all pairs give it, and little more than the rows themselves is moved."""
    rng = random.Random(5)
    rides = [(rng.randrange(2), rng.randrange(0, 4000, 20), rng.randrange(40), k) for k in range(400)] + [(0, 8000 + k, 3, 1000 + k) for k in range(30)]
    waits = [(rng.randrange(3), rng.randrange(0, 5000, 20), rng.randrange(40), k) for k in range(400)] + [(0, 8000, 3, 400)]
    waiting = spark.createDataFrame(waits, "stop_id long, arrival long, trip_id long, who long")
    on = spark.createDataFrame(rides, "stop_id long, departure long, trip_id long, sequence long").select("stop_id", F.struct("departure", "trip_id", "sequence").alias("ride"))
    found = []
    with unbroadcast(spark):
        n = shuffled(spark, lambda: found.extend(journeys.next_rides(waiting, on, 300).collect()))
    want = {who: min((r[1:] for r in rides if r[0] == stop and r[2] != trip and at <= r[1] <= at + 300), default=None) for stop, at, trip, who in waits}
    assert {r.who: r.ride and tuple(r.ride) for r in found} == want and len(found) == 401 and None in want.values() and n <= len(rides) + len(waits)


def test_rounds_leave_the_network_where_it_is(spark):
    """Rounds along a line of five trips: the thousands of hops elsewhere are dealt out once, not a round each; a stop reached again sooner boards only what it couldn't before."""
    schema = "trip_id long, stop_sequence long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, pickup_type int, drop_off_type int"
    far = [(1000 + t, s, 100 + 7 * t % 900 + s, 101 + 7 * t % 900 + s, 600 * s, 600 * s + 500, 0, 0) for t in range(1000) for s in (1, 2, 3)]
    line = [(k, 1, k, k + 1, 1000 * k, 1000 * k + 500, 0, 0) for k in range(1, 6)] + [(50, 1, 1, 3, 900, 2700, 0, 0), (51, 1, 3, 60, 2800, 2900, 0, 0), (52, 1, 3, 60, 2500, 2600, 0, 0), (53, 1, 3, 61, 2600, 2650, 0, 0)]
    hops = spark.createDataFrame(far + line, schema)
    walks = spark.createDataFrame([(3, 3, 2, 10)], "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int")
    origins = spark.createDataFrame([(1, 1, 800)], "query_id int, stop_id long, arrival long")
    want = {1: 800, **{k + 1: 1000 * k + 500 for k in range(1, 6)}, 60: 2900, 61: 2650}
    with unbroadcast(spark):
        for rounds in (search.earliest_to_fixpoint, lambda *a: search.earliest_arrivals(*a, boardings=7)):
            found = []
            n = shuffled(spark, lambda: found.extend(rounds(origins, hops, walks).collect()))  # noqa: B023
            assert {r.stop_id: r.arrival for r in found} == want and n < 4 * (len(far) + len(line))
    assert keep.remove_kept(spark) and not [t for t in spark.catalog.listTables("default") if t.name.startswith(("calls_", "boards_"))]


def test_chains_of_labels_are_moved_once(spark):
    """Of 200 chains of six labels each, only rides, walks and changes go on to what they are looked up in; a break of each kind is found."""
    label = "chain_id long, position int, kind string, stop_id long, departure long, arrival long, trip_id long, can_alight boolean, transfers int, cost double"
    hop = "trip_id long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, pickup_type int, drop_off_type int, leg_cost double"
    hops, chains, asked = [], [], []
    for c in range(200):
        one, two, at = 10 * c, 10 * c + 5, 100 * c
        hops += [(one, at + k, at + k + 1, 1000 * k, 1000 * k + 500, 0, 0, 0.25) for k in range(3)] + [(two, at + 4, at + 5, 3000, 3500, 0, 0, 0.5)]
        rides = [(c, k + 1, "ride", at + k + 1, 1000 * k, 1000 * k + 500, one, True, 0, 0.25) for k in range(3)]
        chains += [(c, 0, "start", at, None, 0, None, True, 0, 0.0), *rides, (c, 4, "walk", at + 4, None, 2620, one, True, 0, 0.25), (c, 5, "ride", at + 5, 3000, 3500, two, True, 1, 0.75)]
        asked.append((c, at, at + 5, 0))
    rules = [(100 * c + 3, 100 * c + 4, 2, 120, None, None) for c in range(200)] + [(704, 704, 3, None, None, 75), (804, 804, 2, 390, 80, None), (904, 904, 3, None, 5, None)]

    def spoil(row, **by):
        names = [c.split()[0] for c in label.split(", ")]
        k = next(i for i, x in enumerate(chains) if x[:2] == row)
        chains[k] = tuple(by.get(c, v) for c, v in zip(names, chains[k], strict=True))

    spoil((1, 2), departure=999)
    spoil((2, 2), arrival=1501)
    spoil((3, 4), arrival=2621)
    spoil((4, 2), cost=0.5)
    spoil((5, 4), stop_id=77)
    spoil((6, 5), can_alight=False)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((chains, label), (asked, "chain_id long, origin long, destination long, departure long"), (hops, hop), (rules, "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int, from_trip_id long, to_trip_id long"))]
    found = []
    with unbroadcast(spark):
        n = shuffled(spark, lambda: found.extend(map(tuple, journeys.chain_violations(*frames).collect())))
    want = {(1, 2): ["a ride that there is not"], (2, 2): ["arrives at another time"], (3, 4): ["a walk of another length"], (4, 2): ["another cost"], (5, 4): ["a walk that there is not"], (5, 5): ["a ride that there is not"], (6, 5): ["ends elsewhere", "gets off wrongly"]}
    want |= {(7, 5): ["changes against a rule"], (8, 5): ["changes against a rule"]}
    assert sorted(found) == sorted((*at, rule) for at, names in want.items() for rule in names)
    assert n <= 2 * len(chains) + len(asked) + len(hops) + 2 * len(rules), n

import random

import pytest

from transitweave.operators.states import state_arrivals, state_labels

HOPS = "trip_id string, stop_sequence int, from_stop_id string, to_stop_id string, departure_seconds int, arrival_seconds int, pickup_type int, drop_off_type int"
RULES = "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int, from_trip_id string, to_trip_id string"
STATION = [("B1", "B2", 2, 120, None, None), ("B2", "B1", 2, 120, None, None)]
TWO = [("T1", 1, "A", "B1", 28800, 29400, 0, 0), ("T2", 1, "B2", "C", 29520, 30000, 0, 0)]


def arrivals(spark, asked, hops, rules, **bounds):
    origins = spark.createDataFrame(asked, "query_id int, stop_id string, arrival long")
    found = state_arrivals(state_labels(origins, spark.createDataFrame(hops, HOPS), spark.createDataFrame(rules, RULES), **bounds))
    return {(r.query_id, r.stop_id, r.transfers): r.arrival for r in found.collect()}


def test_station_transfers_and_changes(spark):
    got = arrivals(spark, [(1, "A", 28800), (2, "B1", 29280)], TWO, STATION, max_transfers=1)
    assert got[1, "C", 1] == 30000 and got[1, "B2", 0] == 29520 and got[2, "C", 0] == 30000
    got = arrivals(spark, [(1, "A", 28800)], TWO, STATION, max_transfers=0)
    assert (1, "C", 1) not in got and got[1, "B1", 0] == 29400


@pytest.mark.parametrize(
    ("rules", "reached"),
    [
        ([], 30000),
        ([("B", "B", 2, 300, None, None)], None),
        ([("B", "B", 2, 300, "other", None)], 30000),
        ([("B", "B", 2, 300, "T1", None)], None),
        ([("B", "B", 3, None, "T1", "T2")], None),
        ([("B", "B", 3, None, "T1", "T9")], 30000),
        ([("B", "B", 3, None, None, "T2")], None),
    ],
)
def test_rules_of_single_trips(spark, rules, reached):
    hops = [("T1", 1, "A", "B", 28800, 29400, 0, 0), ("T2", 1, "B", "C", 29520, 30000, 0, 0)]
    assert arrivals(spark, [(1, "A", 28800)], hops, rules).get((1, "C", 1)) == reached


def test_getting_off_and_riding_on(spark):
    """One can't get off at B, but ride on to C; nor board T2 at B, nor T3, whose pickup is not regular."""
    hops = [("T1", 1, "A", "B", 28800, 29400, 0, 1), ("T1", 2, "B", "C", 29460, 30000, 0, 0), ("T2", 1, "B", "D", 29500, 29600, 0, 0), ("T3", 1, "C", "D", 30100, 30200, 3, 0), ("T4", 1, "C", "D", 30300, 30400, 0, 0)]
    got = arrivals(spark, [(1, "A", 28800)], hops, [])
    assert (1, "B", 0) not in got and got[1, "C", 0] == 30000 and got[1, "D", 1] == 30400
    assert arrivals(spark, [(1, "A", 28800)], hops, [], horizon=600) == {(1, "A", 0): 28800}


def relaxed(asked, hops, rules, max_transfers, horizon):
    """Earliest arrival of each state and number of changes, hop by hop until nothing improves."""
    best = {}

    def put(key, t):
        if best.get(key, t + 1) > t:
            best[key] = t
            return True
        return False

    for q, stop, t in asked:
        until, more = t + horizon, put((q, stop, None, True, None, 0), t)
        while more:
            more = False
            for (query, s, trip, off, required, changes), at in list(best.items()):
                if query != q:
                    continue
                for a, b, kind, least, own, then in rules:
                    if off and a == s != b and kind != 3 and (own is None or own == trip):
                        more |= put((q, b, trip, True, then, changes), at + (least or 0))
                for h in hops:
                    if h[2] != s or h[4] < at or h[4] > until:
                        continue
                    if h[0] != trip:
                        mine = [r for r in rules if r[0] == r[1] == s and r[4] in (None, trip) and r[5] in (None, h[0])]
                        if not off or h[6] or any(r[2] == 3 for r in mine) or h[4] < at + max((r[3] or 0 for r in mine), default=0) or required not in (None, h[0]):
                            continue
                    n = changes + (trip is not None and h[0] != trip)
                    if n <= max_transfers:
                        more |= put((q, h[3], h[0], not h[7], None, n), h[5])
    least = {}
    for (q, s, _, off, _, n), t in best.items():
        if off:
            least[q, s, n] = min(t, least.get((q, s, n), t))
    return {(q, s, n): t for (q, s, n), t in least.items() if all(least.get((q, s, m), t + 1) > t for m in range(n))}


def test_against_relaxation(spark):
    """Ten random networks with rules of single trips, searched together."""
    asked, hops, rules = [], [], []
    for seed in range(10):
        rng = random.Random(seed)
        stop = lambda k: f"{seed}-{k}"  # noqa: B023, E731
        for trip in range(12):
            at, t = rng.randrange(6), 28800 + rng.randrange(0, 3600, 60)
            for k in range(rng.randrange(1, 5)):
                to = rng.choice([s for s in range(6) if s != at])
                arrival = t + rng.randrange(120, 900, 60)
                hops.append((f"{seed}/{trip}", k + 1, stop(at), stop(to), t, arrival, rng.choice([0, 0, 0, 1, 3]), rng.choice([0, 0, 0, 1, 3])))
                at, t = to, arrival + rng.choice([0, 60])
        name = lambda: rng.choice([None, f"{seed}/{rng.randrange(12)}"])  # noqa: B023, E731
        for _ in range(8):
            rules.append((stop(rng.randrange(6)), stop(rng.randrange(6)), rng.choice([2, 2, 2, 3]), rng.choice([None, 60, 300]), name(), name()))
        asked += [(10 * seed + k, stop(k), 28800) for k in range(3)]
    want = relaxed(asked, hops, rules, 2, 7200)
    got = arrivals(spark, asked, hops, rules, max_transfers=2, horizon=7200)
    assert got == want and len(want) > 100

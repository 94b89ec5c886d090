import random

import duckdb
import pytest
from pyspark.sql import functions as F

from transitweave.functions import gtfs
from transitweave.operators import search, timetable
from transitweave.plans import oracle, transit

DIR = "/root/testdata/sf0.001"


def test_times(spark):
    df = spark.createDataFrame([("25:15:09",), (" 5:04:00",), ("24:60:00",), ("x",), (None,)], "t string").select(gtfs.gtfs_seconds(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [90909, 18240, None, None, None]


def test_windows_and_delays(spark):
    df = spark.createDataFrame([(21599, -121), (21600, -120), (36000, 300), (54000, 301), (68400, 0), (90000, None)], "t int, d int")
    rows = df.select(gtfs.time_window(F.col("t")).alias("w"), gtfs.delay_class(F.col("d")).alias("c")).collect()
    assert [r.w for r in rows] == ["overnight", "morning_peak", "midday", "afternoon_peak", "evening", "overnight"]
    assert [r.c for r in rows] == ["early", "on_time", "on_time", "late", "on_time", None]


def test_score(spark):
    df = spark.createDataFrame([(0.8, 1200, 600, 0)], "r double, d int, f int, t int")
    assert df.select(gtfs.percent_score(F.col("r"), F.col("d"), F.col("f"), F.col("t")).alias("s")).first().s == pytest.approx(65.0)
    with pytest.raises(ValueError):
        gtfs.percent_score(F.col("r"), F.col("d"), F.col("f"), F.col("t"), (0.0, 0.0, 0.0))


def test_search_with_a_walk(spark):
    hops = spark.createDataFrame([(1, 1, 2, 28800, 29400, 1, 0, 0), (2, 3, 4, 29700, 30600, 1, 0, 0)], "trip_id long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, stop_sequence long, pickup_type int, drop_off_type int")
    walks = spark.createDataFrame([(2, 3, 2, 120)], "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int")
    out = search.earliest_arrivals(spark.createDataFrame([(1, 1, 28700)], "query_id int, stop_id long, arrival long"), hops, walks)
    assert {(r.stop_id, r.arrival) for r in out.collect()} == {(1, 28700), (2, 29400), (3, 29520), (4, 30600)}
    with pytest.raises(search.SearchLimit):
        search.earliest_arrivals(spark.createDataFrame([(1, 1, 28700)], "query_id int, stop_id long, arrival long"), hops, walks, deadline_s=1e-9)


def test_pareto(spark):
    rows = [(1, 10, 0.5, 0), (1, 10, 0.5, 0), (1, 12, 0.6, 0), (1, 12, 0.4, 1), (1, 15, 0.4, 1), (2, 99, 9.0, 2)]
    out = search.pareto(spark.createDataFrame(rows, "g int, arrival int, cost double, transfers int"), ["g"])
    assert sorted(map(tuple, out.collect())) == [(1, 10, 0.5, 0), (1, 12, 0.4, 1), (2, 99, 9.0, 2)]


@pytest.mark.parametrize("piece", [3, 10])
def test_pareto_of_large_groups(spark, piece, monkeypatch):
    """One group with nearly all rows, a small one and one without a key, against all pairs; the large one is dealt in many pieces."""
    monkeypatch.setattr(search, "_PIECE", piece)
    rng = random.Random(7)
    rows = [(rng.choice([1] * 40 + [2, None]), a := rng.randrange(400), float(800 - a + rng.randrange(0, 90)), rng.randrange(6)) for _ in range(3000)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "g int, arrival int, cost double, transfers int, other int")
    by = {}
    for r in set(rows):
        by.setdefault(r[0], []).append(r[1:])
    want = {(g, *x) for g, own in by.items() for x in own if not any(y != x and all(p <= q for p, q in zip(y, x, strict=True)) for y in own)}
    out = search.pareto(df, ["g"]).collect()
    assert len(out) == len(want) > 50 and {tuple(r)[:4] for r in out} == want
    assert search.pareto(df.where("false"), ["g"]).count() == 0


def test_stop_search_bounds(spark):
    stops = spark.createDataFrame([(1, "Main")], "stop_id long, stop_name string")
    with pytest.raises(ValueError):
        timetable.search_stops(stops, stops, " a ")


@pytest.mark.parametrize("name", sorted(transit.REGISTERED))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    sql = oracle.oracle_sql()[name]
    mine = transit.REGISTERED[name](spark, DIR)
    cols = sorted(mine.columns)
    theirs = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    norm = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(mine.select(*cols).collect()) == norm(theirs)


def _relaxed(origin, at, hops, transfers):
    """Earliest arrivals by relaxing until nothing changes; a place is (stop, came by a ride)."""
    rules, trips, best = {}, {}, {(origin, False): at}
    for r in transfers:
        if r.from_stop_id == r.to_stop_id:
            rules.setdefault(r.from_stop_id, []).append(None if r.transfer_type == 3 else r.min_transfer_time or 0)
    for h in sorted(hops, key=lambda h: (h.trip_id, h.stop_sequence)):
        trips.setdefault(h.trip_id, []).append(h)
    changed = True
    while changed:
        before = dict(best)

        def relax(place, t):
            best[place] = min(t, best.get(place, t))

        for (stop, ridden), t in before.items():
            for r in transfers:
                if r.from_stop_id == stop != r.to_stop_id and r.transfer_type != 3:
                    relax((r.to_stop_id, False), t + (r.min_transfer_time or 0))
            own = rules.get(stop, []) if ridden else []
            if None in own:
                continue
            for legs in trips.values():
                for k, h in enumerate(legs):
                    if h.from_stop_id == stop and h.departure_seconds >= t + max(own, default=0) and h.pickup_type != 1 and h.drop_off_type != 1:
                        for i, x in enumerate(legs[k:], k):
                            if i > k and (x.from_stop_id != legs[i - 1].to_stop_id or x.departure_seconds < legs[i - 1].arrival_seconds):
                                break
                            relax((x.to_stop_id, True), x.arrival_seconds)
        changed = best != before
    return {stop: min(t for (s, _), t in best.items() if s == stop) for stop, _ in best}


def test_earliest_arrivals_to_the_fixpoint(spark):
    hops = "trip_id long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, stop_sequence long, pickup_type int, drop_off_type int"
    rows = [(k, k, k + 1, 1000 * k, 1000 * k + 500, 1, 0, 0) for k in range(1, 6)]  # five boardings
    rows += [(10, 22, 30, 9000, 9500, 1, 0, 0), (11, 30, 31, 9600, 9700, 1, 0, 0), (12, 30, 31, 9900, 9950, 1, 0, 0), (13, 31, 32, 20000, 20001, 1, 0, 0), (13, 32, 33, 19000, 19001, 2, 0, 0)]
    walks = [(6, 20, 2, 60), (20, 21, 2, 60), (21, 22, 0, None), (30, 30, 2, 300), (3, 3, 0, None), (31, 40, 3, None), (31, 31, 3, None)]
    h, w = spark.createDataFrame(rows, hops), spark.createDataFrame(walks, "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int")
    got = {r.stop_id: r.arrival for r in search.earliest_to_fixpoint(spark.createDataFrame([(1, 1, 900)], "query_id int, stop_id long, arrival long"), h, w).collect()}
    assert got == _relaxed(1, 900, h.collect(), w.collect()) and got[6] == 5500 and got[22] == 5620 and got[31] == 9950 and 32 not in got


def test_earliest_arrivals_of_a_service_day(spark):
    n = transit.Network(spark, DIR)
    hops = transit.service_day_hops(n, "2026-06-29")
    assert {r.service_id for r in hops.select("service_id").distinct().collect()} == {"1-URGENT", "2-HIGH", "4-NOT SPECIFIED"}
    hops, transfers = hops.collect(), timetable.station_transfers(n.stops(), n.transfers()).collect()
    got = {(r.query_id, r.stop_id): r.arrival for r in transit.UNBOUNDED["earliest_arrival_fixpoint"](spark, DIR).collect()}
    assert got == {(q, s): t for q, origin, at in ((1, 1, 28800), (2, 2, 28800), (3, 1, 50400)) for s, t in _relaxed(origin, at, hops, transfers).items()}

import pytest
from pyspark.sql import functions as F

from transitweave.operators import cleaning, journeys, realtime, simulation
from transitweave.operators.reliability import Profiles
from transitweave.sources import feed
from transitweave.streaming import observations as streamed

OBSERVED = "trip_id long, stop_id string, stop_sequence long, service_date date, scheduled_arrival int, observed_at timestamp, delay_seconds long"


@pytest.fixture
def folder(tmp_path):
    for name in feed.TABLES:
        fields = [f.file_name for f in feed.fields(name) if f.file_name not in feed.UNNAMED.get(name, [])]
        (tmp_path / f"{name}.txt").write_text(",".join(fields) + "\n")

    def fill(name, *rows):
        with (tmp_path / f"{name}.txt").open("a") as f:
            f.writelines(r + "\n" for r in rows)

    fill("agency", "A,Agency,u,z,,,")
    fill("calendar", "S,1,1,1,1,1,0,0,20260101,20261231", "T,yes,1,1,1,1,0,0,20260101,20261231", "U,1,1,1,1,1,0,0,20260230,20261231")
    fill("routes", "R,A,1,,,3,,,", "Q,B,2,,,3,,,", "P,A", ",A,4,,,3,,,")
    fill("stops", "1,,Main,,49.5,-123.1,,,0,9,", "2,,Side,,49.6,-123.2,,,0,1,", "3,,Far,,x,-123.2,,,0,,")
    fill("trips", "R,S,t1,,,0,,,,", "Q,S,t2,,,0,,,,")
    fill("stop_times", "t1,25:15:09,25:16:00,1,1,,,,,", "t1,24:60:00,,1,2,,,,,", "t2,05:00:00,,1,1,,,,,")
    fill("directions", "North,0,R,1,x")
    (tmp_path / "translations.txt").write_text("﻿table_name,field_name,language,translation,record_id\na,b,c,d,e\n")
    return str(tmp_path)


def test_feed(spark, folder, tmp_path):
    found = cleaning.judged(feed.read_feed(spark, folder))
    n = {(r.table, r.reason): r.n for r in cleaning.reason_counts(found).collect()}
    assert n["calendar", "invalid monday"] == 1 and n["calendar", "invalid start_date"] == 1 and n["calendar", None] == 1
    assert n["routes", "orphan agency_id"] == 1 and sum(v for (t, r), v in n.items() if t == "routes" and r and r.startswith("wrong number of values at row ")) == 1 and n["routes", "empty route_id"] == 1
    assert n["stops", "invalid stop_lat"] == 1 and n["stops", "orphan parent_station"] == 1 and n["stops", None] == 1
    assert n["trips", "orphan route_id"] == 1 and n["stop_times", "invalid arrival_time"] == 1 and n["translations", None] == 1
    assert n["directions", None] == 1 and found["directions"].first().route_do == "x"
    target = f"{tmp_path}/out"
    rows = {r.table: r.rows for r in feed.write_feed(cleaning.kept(found), target).collect()}
    assert rows["trips"] == 1 and feed.stored(spark, target, "trips").first().trip_id == "t1"
    with pytest.raises(feed.FeedError):
        feed.write_feed(cleaning.kept(found), target)
    feed.write_feed({"agency": found["agency"]}, target, replace=True)
    assert feed.stored(spark, target, "agency").count() == 1


def test_headers(spark, tmp_path):
    for bad in (["service_id"], ["service_id", "date", "exception_type", "more"], ["service_id", "date", "date", "exception_type"]):
        with pytest.raises(feed.FeedError):
            feed.effective_header("calendar_dates", bad)
    assert feed.effective_header("calendar_dates", ["date", "service_id", "exception_type"])[0] == "date"
    with pytest.raises(feed.FeedError):
        feed.read_feed(spark, str(tmp_path))


def test_realtime(spark):
    up = lambda stop, seq, arrival=None, departure=None: (stop, seq, arrival, departure)
    entity = [
        ("e1", (("t1", "20260804"), [up("1", None, (0, None)), up(None, 2, None, (None, 1785855600 + 30)), up(None, None), up("9", 1), up("1", 1)])),
        ("e2", (("", "20260804"), [])),
        ("e3", (("t1", "20261399"), [])),
        ("e4", None),
    ]
    feeds = spark.createDataFrame([((1785850000,), entity)], realtime.FEED)
    schedule = spark.createDataFrame([("t1", "1", 1, 25200, 25200), ("t1", "2", 2, 28800, None)], "trip_id string, stop_id string, stop_sequence int, arrival_seconds int, departure_seconds int")
    assert sorted((r.stop_id, r.delay_seconds) for r in realtime.observations(feeds, schedule).collect()) == [("1", 0), ("2", 30)]
    assert tuple(realtime.counters(feeds, schedule).first()) == (3, 5, 3, 1, 1)
    found = realtime.observations(feeds, schedule)
    assert realtime.new_observations(found.unionByName(found), found.where("stop_id = '1'")).count() == 1


def test_stream_keeps_the_newest(spark, tmp_path):
    rows = "(1L, 'a', 1L, DATE'2026-01-01', 60, TIMESTAMP'2026-01-01 00:0{}:00', {}L)".format
    for k, part in enumerate([[rows(1, 5), rows(2, 7)], [rows(1, 5)]]):
        spark.sql("SELECT * FROM VALUES " + ", ".join(part) + " AS t(trip_id, stop_id, stop_sequence, service_date, scheduled_arrival, observed_at, delay_seconds)").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streamed.keep_newest(stream, f"{tmp_path}/out", f"{tmp_path}/state", 1)
    query.awaitTermination(120)
    assert [r.delay_seconds for r in streamed.newest(spark, f"{tmp_path}/out").collect()] == [7]
    assert streamed.compact(spark, f"{tmp_path}/out") == 1 and streamed.compact(spark, f"{tmp_path}/out") == 0
    assert [r.delay_seconds for r in streamed.newest(spark, f"{tmp_path}/out").collect()] == [7]
    query = streamed.unrepeated(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/once").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_simulation_ranking(spark):
    ranked = simulation.simulation_ranking(spark.createDataFrame([("i", 0, 100, 0.5, 0.5), ("j", 0, 200, 1.0, 1.0)], "itinerary_id string, departure int, arrival int, completion double, adherence double").withColumn("g", F.lit(1)), ["g"])
    assert {r.itinerary_id: (r["rank"], r.score) for r in ranked.collect()} == {"j": (1, 90.0), "i": (2, 60.0)}


def test_journeys(spark):
    hops = [(1, 1, 2, 28800, 29400, 1, 2), (1, 2, 5, 29460, 32400, 2, 3), (2, 3, 5, 29700, 30600, 1, 2), (3, 2, 5, 29410, 30000, 1, 2)]
    hops = spark.createDataFrame([(*h, 0, 0, h[0], 0) for h in hops], "trip_id long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, stop_sequence long, to_sequence long, pickup_type int, drop_off_type int, route_id long, direction_id int")
    rules = spark.createDataFrame([(2, 3, 2, 120, None, None), (2, 2, 2, 60, None, None)], "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int, from_trip_id long, to_trip_id long")
    samples = spark.createDataFrame([(1, "d", r, 0, "morning_peak", float(0 if k % 2 or r == 2 else 900)) for r in (1, 2) for k in range(10)], "trip_id long, service_date string, route_id long, direction_id int, time_window string, delay double")
    ask = spark.createDataFrame([(1, 1, 5, 28700, 10800), (2, 1, 5, 30000, 10800)], "query_id int, origin long, destination long, departure long, horizon long")
    found = journeys.journeys(ask, hops, rules, Profiles(samples))
    got = sorted((r.query_id, r.arrival, [x.trip_id for x in r.path]) for r in found.collect())
    assert got == [(1, 30600, [1, 2]), (1, 32400, [1])]  # trip 3 leaves within the minimum of a minute
    legs = journeys.legs_of(found.withColumnRenamed("arrival", "end"), ["query_id", "end"])
    assert journeys.path_violations(legs, ["query_id", "end"]).count() == 0
    assert journeys.leg_stops(legs.where("trip_id = 2"), hops, ["query_id", "end"]).count() == 2
    assert journeys.itineraries(found).where("arrival = '08:30:00'").first().legs[0].departure == "08:00:00"
    bad = spark.createDataFrame([(1, 0, 5, 1, 2, 10, 5), (1, 1, 5, 2, 3, 1, 9)], "k int, position int, trip_id long, from_sequence long, to_sequence long, departure long, arrival long")
    assert journeys.path_violations(bad, ["k"]).count() == 3
    hop = spark.createDataFrame([(1, 0, 7, 1, 1, 2, 10, 20), (1, 1, 7, 2, 2, 3, 21, 30), (1, 2, 8, 1, 3, 4, 40, 50)], "k int, position int, trip_id long, stop_sequence long, from_stop_id long, to_stop_id long, departure long, arrival long")
    assert sorted((r.trip_id, r.from_stop, r.to_stop, r.hops) for r in journeys.merged_legs(hop, ["k"]).collect()) == [(7, 1, 3, 2), (8, 3, 4, 1)]

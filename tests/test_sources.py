import json

import pytest
from pyspark.sql import functions as F

from transitweave.functions import settings
from transitweave.operators import cleaning, realtime
from transitweave.sources import captures, stored
from transitweave.streaming import observations as streamed

EMPTY = {
    "transfers": "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int",
    "calendar": "service_id string, days string, start_date date, end_date date",
    "calendar_dates": "service_id string, service_date date, exception_type int",
    "profiles": "route_id long, direction_key int, time_window string, n long, reliability double",
    "fallback_profiles": "profile_level string, route_key string, direction_key long, n long, reliability double",
}
HOPS = "trip_id long, stop_sequence long, from_stop_id long, to_stop_id long, departure_seconds long, arrival_seconds long, pickup_type int, drop_off_type int, route_id long, direction_id int, service_id string"


def tables(spark, hops):
    out = {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}
    out["stops"] = spark.createDataFrame([(1, "One", 1, 49.0, -123.0), (2, "Two", 1, 49.1, -123.1)], "stop_id long, stop_name string, parent_station long, stop_lat double, stop_lon double")
    return out | {"hops": spark.createDataFrame(hops, HOPS)}


def test_stored_timetable(spark, tmp_path):
    good, bad = (1, 1, 1, 2, 28800, 29400, 0, 0, 1, 0, "s"), (2, 1, 1, 9, 28800, 28000, 0, 0, 1, 0, "s")
    with pytest.raises(stored.TimetableError):
        stored.read_timetable(spark, f"{tmp_path}/none")
    target = f"{tmp_path}/t"
    stored.write_timetable(tables(spark, [good]), target, "2026", 12.5)
    t = stored.read_timetable(spark, target)
    assert t.counts["hops"] == 1 and t.source_version == "2026" and json.loads(stored.manifest_json(t))["maximum_speed"] == 12.5
    assert stored.violations(t).count() == 0 and stored.stop_catalog(spark, target).count() == 2
    stored.write_timetable(tables(spark, [good, bad]), target)
    found = {r.rule: r.rows for r in stored.violations(stored.read_timetable(spark, target)).collect()}
    assert found == {"hop arrives before it departs": 1, "hop ends at an unknown stop": 1}
    with pytest.raises(stored.TimetableError):
        stored.write_timetable({k: v.drop("stop_name") if k == "stops" else v for k, v in tables(spark, [good]).items()}, target)


def test_stored_columns_keep_their_types(spark, tmp_path):
    target = f"{tmp_path}/t"
    version = stored.write_timetable(tables(spark, [(1, 1, 1, 2, 28800, 29400, 0, 0, 1, 0, "s")]), target)
    t = stored.read_timetable(spark, target)
    t.tables["hops"].withColumn("trip_id", F.lit("1")).write.parquet(f"{tmp_path}/other")
    (tmp_path / "t" / f"version={version}" / "hops").rename(tmp_path / "old")
    (tmp_path / "other").rename(tmp_path / "t" / f"version={version}" / "hops")
    with pytest.raises(stored.TimetableError, match="in place of"):
        stored.read_timetable(spark, target)


def test_stored_rules_and_speed(spark, tmp_path):
    hops = [(1, 1, 1, 2, 28800, 29400, 0, 0, 1, 0, "s"), (1, 2, 1, 2, 29500, 30000, 0, 0, 1, 0, "s"), (1, 2, 1, 2, 29500, 30000, 0, 0, 1, 0, "s")]
    given = tables(spark, hops)
    given["calendar"] = spark.createDataFrame([("s", "1111100", "2026-02-01", "2026-01-01")], "service_id string, days string, start_date string, end_date string").selectExpr("service_id", "days", "date(start_date) start_date", "date(end_date) end_date")
    given["profiles"] = spark.createDataFrame([(1, 0, "midday", 5, 0.5), (1, 0, "midday", 5, float("nan")), (2, 0, "midday", 0, 1.0)], EMPTY["profiles"])
    target = f"{tmp_path}/t"
    stored.write_timetable(given, target, None, 1000.0)
    t = stored.read_timetable(spark, target)
    assert {r.rule: r.rows for r in stored.violations(t).collect()} == {
        "hop is there twice": 1, "trip goes on from another stop": 2, "trip leaves before it has come": 1, "calendar ends before it starts": 1, "profiles: out of range": 2, "profiles: there twice": 1,
    }
    assert stored.checked_speed_bound(t).first() == (True, 1000.0, None)
    for declared, reason in ((1.0, "the declared bound is too low"), (float("nan"), "the declared bound is no positive number"), (float("inf"), "the declared bound is no positive number"), (None, "no bound is declared")):
        t.speed_bound = declared
        assert stored.checked_speed_bound(t).first() == (False, None, reason)
    t.speed_bound, t.tables["hops"] = 1000.0, t.tables["hops"].withColumn("arrival_seconds", F.col("departure_seconds"))
    assert stored.checked_speed_bound(t).first() == (False, None, "takes no time: ride")
    t.tables["hops"] = t.tables["hops"].where("false")
    assert stored.checked_speed_bound(t).first() == (False, None, "no edge leads elsewhere")


def test_fixture_file(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"stops": [{"stop_id": "A", "stop_name": "a"}], "connections": [{"trip_id": "T", "from_stop_id": "A", "to_stop_id": "B", "departure_seconds": 1, "arrival_seconds": 2}], "source_version": "v"}, indent=1))
    found = stored.read_fixture(spark, str(path))
    assert found["stops"].first().stop_id == "A" and found["hops"].first().pickup_type == 0 and found["profiles"].count() == 0
    path.write_text('{"stops": []}')
    with pytest.raises(stored.TimetableError):
        stored.read_fixture(spark, str(path))


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_captures(spark, tmp_path):
    stop = field(1, 3) + field(4, "S") + field(2, field(1, -30)) + field(9, "unknown")
    update = field(1, field(1, "T") + field(3, "20260630")) + field(2, stop)
    whole = field(1, field(1, "2.0") + field(3, 1782806400)) + field(2, field(1, "e") + field(3, update)) + field(2, field(1, "alert"))
    for name, data in {"a.pb": whole, "b.pb": b"", "c.pb": b"  <html>no</html>", "d.pb": whole[:-3], "e.pb": b"\xff" * 12}.items():
        (tmp_path / name).write_bytes(data)
    rows = captures.read_captures(spark, str(tmp_path))
    reasons = {r.path[-4:]: r.reason for r in rows.collect()}
    assert reasons["a.pb"] is None and reasons.get("b.pb", "empty") == "empty" and reasons["c.pb"] == "a web page" and reasons["d.pb"] and reasons["e.pb"]
    schedule = spark.createDataFrame([("T", "S", 3, 90000, 90000)], "trip_id string, stop_id string, stop_sequence int, arrival_seconds int, departure_seconds int")
    found = realtime.observations(captures.usable(rows), schedule).collect()
    assert [(r.trip_id, r.stop_id, r.delay_seconds, r.scheduled_arrival) for r in found] == [("T", "S", -30, 90000)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Vancouver"])
def test_delays_in_any_session_zone(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT CAST(NULL AS INT) AS delay, 1782889320L AS time, DATE'2026-06-30' AS d").select(realtime.event_delay(F.struct("delay", "time"), F.lit(90000), F.col("d"), "America/Vancouver").alias("x")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert row.x == 1782889320 - (1782802800 + 90000)  # midnight of 30 June in Vancouver is 07:00 UTC


def test_settings():
    values = {"A": "7", "B": "-1", "C": "x", "D": "2.5", "E": "inf", "F": "Yes", "G": "maybe"}
    assert [settings.positive_int(k, 3, values) for k in "ABCZ"] == [7, 3, 3, 3]
    assert [settings.positive_float(k, 1.5, values) for k in "DECB"] == [2.5, 1.5, 1.5, 1.5]
    assert [settings.boolean(k, False, values) for k in "FGA"] == [True, False, False]


def test_upsert_of_samples(spark):
    schema = "trip_id long, service_date string, time_window string, delay double, stops long"
    old = spark.createDataFrame([(1, "d", "w", 5.0, 2), (2, "d", "w", 6.0, 2), (3, "d", "w", 7.0, 1)], schema)
    new = spark.createDataFrame([(1, "d", "w", 5.0, 2), (2, "d", "w", 9.0, 2), (4, "d", "w", None, 1)], schema)
    got = {r.trip_id: (r.delay, r.changed) for r in streamed.changed_samples(new, old).collect()}
    assert got == {1: (5.0, False), 2: (9.0, True), 3: (7.0, False), 4: (None, True)}


def test_cleaning_is_dry_if_asked(spark, tmp_path):
    from transitweave.sources import feed

    for name in feed.TABLES:
        (tmp_path / f"{name}.txt").write_text(",".join(f.file_name for f in feed.fields(name) if f.file_name not in feed.UNNAMED.get(name, [])) + "\n")
    (tmp_path / "routes.txt").write_text((tmp_path / "routes.txt").read_text() + "R,none,1,,,3,,,\n")
    target = f"{tmp_path}/out"
    assert [(r.table, r.reason, r.n) for r in cleaning.cleaned_feed(spark, str(tmp_path), target, dry_run=True).collect()] == [("routes", "orphan agency_id", 1)]
    with pytest.raises(feed.FeedError):
        feed.stored(spark, target, "routes")
    cleaning.cleaned_feed(spark, str(tmp_path), target)
    assert feed.stored(spark, target, "routes").count() == 0

import csv
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from transitweave.operators import cleaning, keep
from transitweave.operators.reliability import KEYS, latest
from transitweave.sources import feed
from transitweave.streaming import merge, visits

OBSERVED = "trip_id long, stop_id string, stop_sequence long, service_date date, scheduled_arrival int, observed_at timestamp, delay_seconds long"


def observed(spark, rows):
    """rows: trip, day, minute, schedule, delay."""
    df = spark.createDataFrame(rows, "trip long, day int, minute int, schedule int, delay long")
    at = F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, day, 0, minute)")
    return df.select(F.col("trip").alias("trip_id"), F.lit("a").alias("stop_id"), F.lit(1).cast("long").alias("stop_sequence"), F.to_date(F.lit("2026-01-01")).alias("service_date"), F.col("schedule").alias("scheduled_arrival"), at.alias("observed_at"), F.col("delay").alias("delay_seconds"))


def run(spark, folder, **bounds):
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = visits.keep_newer(stream, f"{folder}/out", f"{folder}/state", **bounds)
    query.awaitTermination(300)
    return query


def test_keyed_state_and_restart(spark, tmp_path):
    """Three batches, a stop, and one more: each visit's newest stays, with ties and nulls; what the state knows appends nothing."""
    rng = random.Random(2)
    batches = [[(rng.randrange(8), 0, rng.randrange(5), rng.choice([None, 60, 120]), rng.choice([None, 1, 2, 3])) for _ in range(30)] for _ in range(4)]
    for k, rows in enumerate(batches[:3]):
        observed(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run(spark, tmp_path)
    same = lambda df: sorted(map(str, df.select(*KEYS, "observed_at", "scheduled_arrival", "delay_seconds").collect()))
    assert same(visits.newest_visits(spark, f"{tmp_path}/out")) == same(latest(observed(spark, sum(batches[:3], []))))
    before = spark.read.parquet(f"{tmp_path}/out").count()
    assert before <= 3 * 8
    observed(spark, batches[0]).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    run(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == before
    observed(spark, batches[3] + [(99, 0, 1, None, None)]).coalesce(1).write.parquet(f"{tmp_path}/in/4")
    run(spark, tmp_path)
    assert same(visits.newest_visits(spark, f"{tmp_path}/out")) == same(latest(observed(spark, sum(batches, [(99, 0, 1, None, None)]))))


def test_visits_are_forgotten(spark, tmp_path):
    """When the watermark has passed two days after their date, the state of visits is gone."""
    for k, rows in enumerate([[(t, 0, t, 60, 1) for t in range(5)], [(7, 9, 0, 60, 1)], [(7, 9, 1, 60, 2)]]):
        observed(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    query = run(spark, tmp_path, late="1 hour", keep=2)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 5 and states[-1] < max(states)


def test_merge(spark, tmp_path):
    schema, folder = "trip_id long, service_date string, time_window string, delay double, stops long", f"{tmp_path}/samples"
    new = lambda *rows: spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError):
        merge.stored_samples(spark, folder)
    assert merge.merge_samples(new((1, "a", "w", 5.0, 2), (2, "a", "w", None, 2), (3, "b", "w", 7.0, 1)), folder, "2026-01-01 00:00:00") == 3
    assert merge.merge_samples(new((1, "a", "w", 5.0, 2), (2, "a", "w", None, 2), (3, "b", "w", 7.0, 1)), folder, "2026-01-02 00:00:00") == 0
    assert merge.merge_samples(new((1, "a", "w", 6.0, 2), (4, "c", "w", 1.0, 1), (3, "b", "w", 7.0, 1)), folder, "2026-01-03 00:00:00") == 2
    rows = lambda: sorted((r.trip_id, r.service_date, r.delay, r.updated_at.day) for r in merge.stored_samples(spark, folder).collect())
    want = [(1, "a", 6.0, 3), (2, "a", None, 1), (3, "b", 7.0, 1), (4, "c", 1.0, 3)]
    assert rows() == want
    assert merge.compact(spark, folder) == 1 and merge.compact(spark, folder) == 0 and rows() == want


def test_row_numbers_of_a_file_in_blocks(spark, tmp_path):
    """Thousands of lines in many blocks, blank ones too, and the same lines in part files: numbers as a plain reader gives them."""
    rng = random.Random(4)
    lines = [",".join("x" * rng.randrange(1, 90) for _ in range(rng.choice([3, 3, 3, 2, 4]))) if rng.random() < 0.98 else "" for _ in range(5000)]
    one, parts = tmp_path / "one.txt", tmp_path / "parts.txt"
    one.write_text("﻿a,b,c\n" + "\n".join(lines) + "\n", encoding="utf-8")
    parts.mkdir()
    for k in range(5):
        (parts / f"part-{k}.csv").write_text("a,b,c\n" + "\n".join(lines[1000 * k : 1000 * (k + 1)]) + "\n")
    with one.open(encoding="utf-8-sig", newline="") as f:
        reader = csv.reader(f)
        next(reader)
        want = [(k, ",".join(row)) for k, row in enumerate(reader, start=2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        for path in (one, parts):
            found = feed.numbered_lines(spark, str(path))
            assert sorted((r[feed.ROW], r.value) for r in found.collect()) == want
        assert spark.read.text(str(one)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_width_reasons_have_row_numbers(spark, tmp_path):
    (tmp_path / "trips.txt").write_text('﻿route_id,service_id,trip_id\nr,s,"a,b"\nr,s\n\nr,s,c,d\nr, ,e\nr,s,f\n', encoding="utf-8")
    found = feed.typed(feed.raw(spark, str(tmp_path), "trips"), "trips", numbered=True)
    assert [(r[feed.ROW], r.trip_id, r.reason) for r in found.orderBy(feed.ROW).collect() if r.reason is None or "row" not in r.reason] == [(2, "a,b", None), (6, "e", "empty service_id"), (7, "f", None)]
    assert [r.reason for r in found.orderBy(feed.ROW).collect() if r.reason and "row" in r.reason] == [f"wrong number of values at row {k}" for k in (3, 4, 5)]
    assert cleaning.reason_counts({"trips": found.drop(feed.ROW)}).where("reason IS NOT NULL").count() == 4


def test_kept_tables_go(spark):
    path = keep.kept(spark.range(3), "gone").inputFiles()[0]
    assert keep.remove_kept(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.exist|not.found|no such"):
        spark.read.parquet(path).count()
    assert keep.remove_kept(spark) == 0


class _Map:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def exists(self):
        return bool(self.rows)

    def getValue(self, who):  # noqa: N802
        self.calls += 1
        return self.rows.get(who)

    def updateValue(self, who, value):  # noqa: N802
        self.calls += 1
        self.rows[who] = value


def test_visits_share_groups():
    """Two calls for two hundred visits of a date: the newest of each go out, and the second reads and writes only what has come."""
    state, timers = _Map(), []
    handle = type("Handle", (), {"getMapState": lambda *_: state, "registerTimer": lambda _, at: timers.append(at)})()
    processor = visits.newest_visit(3, {"trip_id": "bigint", "stop_id": "string", "stop_sequence": "bigint"})
    processor.init(handle)
    frame = lambda rows: pd.DataFrame([(t, None, 1, pd.Timestamp(2026, 1, 1, 0, m), s, 5) for t, m, s in rows], columns=["trip_id", "stop_id", "stop_sequence", "observed_at", "scheduled_arrival", "delay_seconds"])
    key = (date(2026, 1, 1), 0)
    (first,) = processor.handleInputRows(key, iter([frame([(t, m, 60) for t in range(200) for m in (1, 2)]), frame([(t, 0, 60) for t in range(200)])]), None)
    assert len(first) == 200 == state.calls and set(first["observed_at"]) == {pd.Timestamp(2026, 1, 1, 0, 2)} and len(timers) == 1
    (second,) = processor.handleInputRows(key, iter([frame([(7, 2, 60), (8, 3, None), (9, 1, 60)])]), None)
    assert list(second["trip_id"]) == [8] and second["scheduled_arrival"].isna().all() and state.calls == 204 and len(timers) == 1

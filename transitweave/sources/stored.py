"""A timetable stored for searches: typed tables in versions, a manifest that comes last, and checks of what is read back.

Hops are dealt by ranges of stop and departure and sorted in them, so a reader
that asks for a stop or a time skips most row groups.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gtfs import haversine_meters
from ..operators.lookups import speed_bound

FORMAT, READABLE = 3, (2, 3)

#: What each table must have; the last two came with format 3.
COLUMNS = {
    "stops": "stop_id stop_name parent_station stop_lat stop_lon",
    "hops": "trip_id stop_sequence from_stop_id to_stop_id departure_seconds arrival_seconds pickup_type drop_off_type route_id direction_id service_id",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time",
    "calendar": "service_id days start_date end_date",
    "calendar_dates": "service_id service_date exception_type",
    "profiles": "route_id direction_key time_window n reliability",
    "fallback_profiles": "profile_level route_key direction_key n reliability",
}
_NEWER = ("profiles", "fallback_profiles")
_ORDER = {"hops": ["from_stop_id", "departure_seconds", "trip_id", "stop_sequence"], "stops": ["stop_id"], "transfers": ["from_stop_id", "to_stop_id"]}
_MANIFEST = "version string, format int, source_version string, counts map<string, long>, first_date date, last_date date, speed_bound double, written_at timestamp, types map<string, string>"


class TimetableError(ValueError):
    """A stored timetable is missing, of an unknown format or not whole."""


@dataclass
class Timetable:
    tables: dict[str, DataFrame]
    counts: dict[str, int]
    source_version: str | None
    first_date: object
    last_date: object
    speed_bound: float | None


def write_timetable(tables: dict[str, DataFrame], target: str, source_version: str | None = None, speed_bound: float | None = None) -> str:
    """Writes a new version under target and returns its name. Readers see it once its line is in the manifest."""
    spark = next(iter(tables.values())).sparkSession
    version, counts, types = uuid.uuid4().hex, {}, {}
    for name, columns in COLUMNS.items():
        df = _wanted(tables, name, columns)
        if name in _ORDER:
            df = df.repartitionByRange(*_ORDER[name]).sortWithinPartitions(*_ORDER[name])
        path = f"{target.rstrip('/')}/version={version}/{name}"
        df.write.parquet(path)
        counts[name], types[name] = spark.read.schema(df.schema).parquet(path).count(), df.schema.simpleString()
    days = tables["calendar"].agg(F.min("start_date"), F.max("end_date")).first()
    line = spark.createDataFrame([(version, FORMAT, source_version, counts, *days, speed_bound, None, types)], _MANIFEST).withColumn("written_at", F.current_timestamp())
    line.coalesce(1).write.mode("append").parquet(f"{target.rstrip('/')}/manifest")
    return version


def _wanted(tables: dict[str, DataFrame], name: str, columns: str) -> DataFrame:
    if name not in tables:
        raise TimetableError(f"no table {name}")
    missing = sorted(set(columns.split()) - set(tables[name].columns))
    if missing:
        raise TimetableError(f"{name}: missing columns {', '.join(missing)}")
    return tables[name].select(*columns.split())


def _newest(spark: SparkSession, target: str):
    try:
        row = spark.read.schema(_MANIFEST).parquet(f"{target.rstrip('/')}/manifest").orderBy(F.desc("written_at"), "version").first()
    except AnalysisException:
        row = None
    if row is None:
        raise TimetableError(f"{target} holds no timetable")
    return row


def read_timetable(spark: SparkSession, target: str) -> Timetable:
    """The newest version. An unknown format, a table or column that is missing, and columns of other types than were written raise; see violations for the rows."""
    row = _newest(spark, target)
    if row.format not in READABLE:
        raise TimetableError(f"unknown format {row.format}")
    tables = {}
    for name, columns in COLUMNS.items():
        if row.format < FORMAT and name in _NEWER:
            continue
        try:
            tables[name] = spark.read.parquet(f"{target.rstrip('/')}/version={row.version}/{name}")
        except AnalysisException as e:
            raise TimetableError(f"{name}: can't be read") from e
        found, known = _wanted(tables, name, columns).schema.simpleString(), (row.types or {}).get(name)
        if known and found != known:
            raise TimetableError(f"{name}: {found} in place of {known}")
    return Timetable(tables, row.counts, row.source_version, row.first_date, row.last_date, row.speed_bound)


def stop_catalog(spark: SparkSession, target: str) -> DataFrame:
    """The stops of the newest version alone: there even where its other tables can't be used."""
    row = _newest(spark, target)
    return spark.read.parquet(f"{target.rstrip('/')}/version={row.version}/stops")


def violations(t: Timetable) -> DataFrame:
    """rule, rows: what a stored timetable must not have, with how many rows have it; rules that hold give none."""
    hops, stops = t.tables["hops"], t.tables["stops"].select("stop_id")
    trip = Window.partitionBy("trip_id").orderBy("stop_sequence")
    along = hops.select("departure_seconds", "from_stop_id", F.lag("arrival_seconds").over(trip).alias("come"), F.lag("to_stop_id").over(trip).alias("at"))
    twice = lambda name, *keys: t.tables[name].groupBy(*keys).count().where("count > 1")
    lost = lambda df, column: df.join(stops.withColumnRenamed("stop_id", column), column, "left_anti")
    broken = {
        "hop arrives before it departs": hops.where("arrival_seconds < departure_seconds"),
        "hop has no time": hops.where("arrival_seconds IS NULL OR departure_seconds IS NULL"),
        "hop starts at an unknown stop": lost(hops, "from_stop_id"),
        "hop ends at an unknown stop": lost(hops, "to_stop_id"),
        "hop without trip, route or sequence": hops.where("trip_id IS NULL OR route_id IS NULL OR stop_sequence IS NULL"),
        "hop is there twice": twice("hops", "trip_id", "stop_sequence"),
        "trip leaves before it has come": along.where("departure_seconds < come"),
        "trip goes on from another stop": along.where("from_stop_id <> at"),
        "hop with an unknown direction": hops.where("direction_id NOT IN (0, 1)"),
        "transfer from an unknown stop": lost(t.tables["transfers"], "from_stop_id"),
        "transfer to an unknown stop": lost(t.tables["transfers"], "to_stop_id"),
        "transfer of an unknown type": t.tables["transfers"].where("transfer_type NOT BETWEEN 0 AND 5"),
        "transfer takes negative time": t.tables["transfers"].where("min_transfer_time < 0"),
        "stop is there twice": twice("stops", "stop_id"),
        "stop off the globe": t.tables["stops"].where("abs(stop_lat) > 90 OR abs(stop_lon) > 180 OR isnan(stop_lat) OR isnan(stop_lon)"),
        "calendar ends before it starts": t.tables["calendar"].where("end_date < start_date"),
        "exception of an unknown type": t.tables["calendar_dates"].where("exception_type NOT IN (1, 2)"),
    }
    for name, keys in (("profiles", ("route_id", "direction_key", "time_window")), ("fallback_profiles", ("profile_level", "route_key", "direction_key"))):
        if name in t.tables:
            broken[f"{name}: out of range"] = t.tables[name].where("n < 1 OR reliability IS NULL OR reliability NOT BETWEEN 0 AND 1")
            broken[f"{name}: there twice"] = twice(name, *keys)
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows") for rule, df in broken.items()]
    counted += [df.agg(F.abs(F.count(F.lit(1)) - t.counts.get(name, 0)).alias("rows")).select(F.lit(f"{name} is not as long as when written").alias("rule"), "rows") for name, df in t.tables.items()]
    return reduce(DataFrame.unionByName, counted).where("rows > 0")


def checked_speed_bound(t: Timetable) -> DataFrame:
    """One row: enabled, meters_per_second, reason. Whether a search may prune by the speed that the manifest declares.

    It may not where none is declared, where that is no positive number, where the rides and walks of the tables give no
    bound, or a greater one than is declared.
    """
    place = lambda side: t.tables["stops"].select(F.col("stop_id").alias(f"{side}_stop_id"), F.col("stop_lat").alias(f"{side}_lat"), F.col("stop_lon").alias(f"{side}_lon"))
    rides = t.tables["hops"].select("from_stop_id", "to_stop_id", (F.col("arrival_seconds") - F.col("departure_seconds")).cast("long").alias("seconds"), F.lit("ride").alias("kind"))
    walks = t.tables["transfers"].where("transfer_type <> 3 AND from_stop_id <> to_stop_id")
    walks = walks.select("from_stop_id", "to_stop_id", F.coalesce("min_transfer_time", F.lit(0)).cast("long").alias("seconds"), F.lit("transfer").alias("kind"))
    placed = rides.unionByName(walks).join(place("from"), "from_stop_id", "left").join(place("to"), "to_stop_id", "left")
    seen = speed_bound(placed.withColumn("metres", haversine_meters(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))))
    declared = F.lit(t.speed_bound).cast("double")
    fault = None if t.speed_bound is not None and 0 < t.speed_bound < math.inf else "no bound is declared" if t.speed_bound is None else "the declared bound is no positive number"
    reason = F.coalesce(F.lit(fault), "reason", F.when(declared < F.col("meters_per_second"), "the declared bound is too low"))
    return seen.select(reason.isNull().alias("enabled"), F.when(reason.isNull(), declared).alias("meters_per_second"), reason.alias("reason"))


FIXTURE = """stops array<struct<stop_id:string,stop_name:string,stop_lat:double,stop_lon:double,parent_station:string>>,
    connections array<struct<trip_id:string,route_id:string,service_id:string,from_stop_id:string,to_stop_id:string,departure_seconds:int,arrival_seconds:int,
    stop_sequence:int,direction_id:int,pickup_type:int,drop_off_type:int>>, source_version string,
    reliability_profiles array<struct<route_id:string,direction_id:int,time_window:string,reliability_probability:double,sample_count:int>>"""


def read_fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON file of stops, hops and, if it has them, profiles, as tables; raises if stops or hops are missing."""
    whole = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    row = whole.select(F.size("stops").alias("stops"), F.size("connections").alias("hops")).first()
    if row is None or min(row.stops or -1, row.hops or -1) < 0:
        raise TimetableError(f"{path}: stops and connections are needed")
    table = lambda column: whole.select(F.inline(column))
    hops = table("connections").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pickup_type", "drop_off_type")})
    return {"stops": table("stops"), "hops": hops, "profiles": table("reliability_profiles"), "source_version": whole.select("source_version")}


def manifest_json(t: Timetable) -> str:
    """What a reader may want to know of a version, as text."""
    return json.dumps({"format_version": FORMAT, "source_version": t.source_version, "counts": t.counts, "first_date": str(t.first_date), "last_date": str(t.last_date), "maximum_speed": t.speed_bound}, sort_keys=True)

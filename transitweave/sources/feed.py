"""The sixteen text tables of a transit feed: typed reading, a reason for each row that can't be used, versioned writing."""

from __future__ import annotations

import csv
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.gtfs import gtfs_seconds

CORRUPT, ROW = "_corrupt", "_row"

# The columns of the feed's files, parents before children. ! is required; t text, i integer,
# d decimal, b boolean, D date, I service-day time. name=file_name where a column has another name in the file.
TABLES = {
    "agency": "agency_id!t agency_name!t agency_url!t agency_timezone!t agency_lang:t agency_phone:t agency_fare_url:t",
    "calendar": "service_id!t monday!b tuesday!b wednesday!b thursday!b friday!b saturday!b sunday!b start_date!D end_date!D",
    "calendar_dates": "service_id!t service_date=date!D exception_type!i",
    "feed_info": "feed_publisher_name!t feed_publisher_url!t feed_lang!t feed_start_date:D feed_end_date:D feed_version:t",
    "routes": "route_id!t agency_id!t route_short_name:t route_long_name:t route_desc:t route_type!i route_url:t route_color:t route_text_color:t",
    "stops": "stop_id!t stop_code:t stop_name!t stop_desc:t stop_lat:d stop_lon:d zone_id:t stop_url:t location_type:i parent_station:t wheelchair_boarding:i",
    "shapes": "shape_id!t shape_pt_lat!d shape_pt_lon!d shape_pt_sequence!i shape_dist_traveled:d",
    "trips": "route_id!t service_id!t trip_id!t trip_headsign:t trip_short_name:t direction_id:i block_id:t shape_id:t wheelchair_accessible:i bikes_allowed:i",
    "stop_times": "trip_id!t arrival_time:I departure_time:I stop_id!t stop_sequence!i stop_headsign:t pickup_type:i drop_off_type:i shape_dist_traveled:d timepoint:i",
    "transfers": "from_stop_id!t to_stop_id!t transfer_type!i min_transfer_time:i from_trip_id:t to_trip_id:t",
    "translations": "table_name!t field_name!t language!t translation!t record_id!t",
    "signup_periods": "sign_id!t from_date!D to_date!D",
    "route_names_exceptions": "route_id!t route_name!t route_do:t name_type:t",
    "direction_names_exceptions": "route_name!t direction_id!i direction_name!t direction_do!i",
    "directions": "direction!t direction_id!i route_id!t route_short_name:t route_do:t",
    "stop_order_exceptions": "route_name!t direction_name!t direction_do!i stop_id!t stop_name!t stop_do!i",
}
#: Columns that rows have but the file's header doesn't name; they come last.
UNNAMED = {"directions": ["route_do"]}
_TYPES = {"t": T.StringType(), "i": T.IntegerType(), "d": T.DecimalType(18, 8), "b": T.BooleanType(), "D": T.DateType(), "I": T.IntegerType()}


class FeedError(ValueError):
    """A feed, or a file's header, isn't as it must be."""


@dataclass(frozen=True)
class Field:
    name: str
    file_name: str
    required: bool
    kind: str


def fields(table: str) -> list[Field]:
    out = []
    for word in TABLES[table].split():
        names, kind = word[:-2], word[-1]
        name, _, other = names.partition("=")
        out.append(Field(name, other or name, word[-2] == "!", kind))
    return out


def effective_header(table: str, found: list[str]) -> list[str]:
    """The names of a file's values; raises for missing, unexpected or repeated ones. Their order is free."""
    header = [h.strip() for h in found]
    header += [u for u in UNNAMED.get(table, []) if u not in header]
    known = {f.file_name for f in fields(table)}
    missing = [f.file_name for f in fields(table) if f.required and f.file_name not in header]
    twice, odd = sorted({h for h in header if header.count(h) > 1}), [h for h in header if h not in known]
    for what, names in (("missing", missing), ("unexpected", odd), ("repeated", twice)):
        if names:
            raise FeedError(f"{table}: {what} columns {', '.join(names)}")
    return header


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _row: the lines of a text file after its header, with their numbers; the header is row 1.

    path may be a folder of part files, each with the header, which count as one file in the order of their
    names. Files are read in blocks, in any order: the lines of each block are counted, the sums of the blocks before
    give each its first number. A block is one row in these sums.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("header", F.when(F.col("block") == 0, 1).otherwise(0))
    before = F.sum(F.col("n") - F.col("header")).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", "header", (F.coalesce(before, F.lit(0)) + 2 - F.col("header")).alias("start"))
    own = F.col("at") - F.col("first")
    return lines.join(starts, ["file", "block"]).where(own >= F.col("header")).select("value", (F.col("start") + own).alias(ROW))


def raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The values of a file as text, with the number of their row; the column _corrupt is set where a row has too few or too many."""
    path = f"{folder.rstrip('/')}/{table}.txt"
    try:
        first = spark.read.text(path).first()
    except AnalysisException as e:
        raise FeedError(f"{table}: no file {path}") from e
    if first is None:
        raise FeedError(f"{table}: an empty file")
    header = effective_header(table, next(csv.reader([first[0].lstrip("\ufeff")])))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, CORRUPT]])
    values = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"columnNameOfCorruptRecord": CORRUPT})
    rows = numbered_lines(spark, path).select("value", ROW, values.alias("v"))
    blank = F.when(F.trim("value") == "", F.col("value"))
    return rows.select(*(F.col(f"v.`{h}`").alias(h) for h in header), F.coalesce(F.col(f"v.{CORRUPT}"), blank).alias(CORRUPT), ROW)


def parsed(text: Column, kind: str) -> Column:
    """A value of its kind; null where it is blank or isn't one."""
    t = F.nullif(F.trim(text), F.lit(""))
    if kind == "i":
        return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
    if kind == "d":
        return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("decimal(18,8)"))
    if kind == "b":
        return F.when(t == "1", True).when(t == "0", False)
    if kind == "D":
        return F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))
    return gtfs_seconds(t).cast("int") if kind == "I" else t


def typed(rows: DataFrame, table: str, numbered: bool = False) -> DataFrame:
    """All columns of a table, and `reason`: null, or the first why a row can't be used.

    Reasons are a wrong number of values, with the number of the row, then required values that are blank, then
    values that aren't of their type, each in the order of columns. Absent optional
    columns are null. With `numbered`, rows keep their number, _row.
    """
    here = [f for f in fields(table) if f.file_name in rows.columns]
    blank = lambda f: F.coalesce(F.trim(F.col(f.file_name)), F.lit("")) == ""
    checks = [F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("wrong number of values at row "), ROW))]
    checks += [F.when(blank(f), f"empty {f.name}") for f in here if f.required]
    checks += [F.when(~blank(f) & parsed(F.col(f.file_name), f.kind).isNull(), f"invalid {f.name}") for f in here if f.kind != "t"]
    names = {f.name for f in here}
    values = [(parsed(F.col(f.file_name), f.kind) if f.name in names else F.lit(None)).cast(_TYPES[f.kind]).alias(f.name) for f in fields(table)]
    return rows.select(*values, F.coalesce(*checks).alias("reason"), *([ROW] if numbered else []))


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder of .txt files, with reasons; all of them must be there."""
    return {name: typed(raw(spark, folder, name), name) for name in TABLES}


def write_feed(tables: dict[str, DataFrame], target: str, replace: bool = False) -> DataFrame:
    """Writes tables as a new version under target; returns table, rows of it.

    Readers see a version once its counts are in the manifest, which comes last: a
    load that breaks off leaves nothing to see. Without replace, a target that
    holds a version is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    if not replace and _newest(spark, target) is not None:
        raise FeedError(f"{target} holds a feed already")
    version, counts = uuid.uuid4().hex, []
    for name, df in tables.items():
        path = f"{target.rstrip('/')}/version={version}/{name}"
        df.write.parquet(path)
        counts.append((version, name, spark.read.schema(df.schema).parquet(path).count()))
    manifest = spark.createDataFrame(counts, "version string, table string, rows long").withColumn("loaded_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{target.rstrip('/')}/manifest")
    return manifest.select("table", "rows")


def _newest(spark: SparkSession, target: str) -> str | None:
    try:
        manifest = spark.read.schema("version string, table string, rows long, loaded_at timestamp").parquet(f"{target.rstrip('/')}/manifest")
        row = manifest.orderBy(F.desc("loaded_at"), "version").first()
    except AnalysisException:
        return None
    return row and row.version


def stored(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of the newest version."""
    version = _newest(spark, target)
    if version is None:
        raise FeedError(f"{target} holds no feed")
    return spark.read.parquet(f"{target.rstrip('/')}/version={version}/{table}")

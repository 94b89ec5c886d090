"""A transit network out of the supplied business tables: the same rules as SQL are in plans.oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALENDAR = [  # service, Monday to Sunday, first and last day
    ("1-URGENT", "1111100", "2026-01-01", "2026-12-31"),
    ("2-HIGH", "1111111", "2026-01-01", "2026-06-30"),
    ("3-MEDIUM", "0000011", "2026-01-01", "2026-12-31"),
    ("4-NOT SPECIFIED", "1010100", "2026-03-01", "2026-09-30"),
    ("5-LOW", "0000000", "2026-01-01", "2026-12-31"),
]
EXCEPTIONS = [("1-URGENT", "2026-07-27", 2), ("5-LOW", "2026-07-27", 1), ("3-MEDIUM", "2026-08-01", 2), ("5-LOW", "2026-08-03", 1)]
TRANSFERS = [(1, 1, 2, 300), (2, 2, 3, None), (1, 2, 2, 240), (3, 5, 0, None), (5, 3, 3, None), (7, 9, 2, 60)]


class Network:
    """DataFrames of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self._read("supplier").select(k.alias("stop_id"), F.col("s_name").alias("stop_name"), F.floor(k / 4).alias("parent_station"), (49 + (k % 97) / 100).alias("stop_lat"), (-123 - (k % 89) / 100).alias("stop_lon"))

    def trips(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self._read("orders").select(k.alias("trip_id"), (F.col("o_custkey") % 50).alias("route_id"), F.when(k % 10 != 0, k % 2).alias("direction_id"), F.col("o_orderpriority").alias("service_id"))

    def routes(self) -> DataFrame:
        r = F.col("route_id")
        return self.trips().select("route_id").distinct().select("route_id", (r % 4).alias("route_type"), F.when(r % 5 != 0, F.concat(F.lit("R"), r)).alias("short_name"), F.when(r % 10 != 0, F.concat(F.lit("Route "), r)).alias("long_name"))

    def stop_times(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lines = self._read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(order).cast("long").alias("stop_sequence"))
        p, dep = F.col("l_partkey"), (F.col("l_orderkey") * 97 % 26) * 3600 + F.col("stop_sequence") * 420
        lines = lines.join(self.trips().select(F.col("trip_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        return lines.select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), "stop_sequence", (dep - 60).alias("arrival_seconds"), dep.alias("departure_seconds"), F.when(p % 11 == 0, 1).when(p % 13 == 0, 3).otherwise(0).alias("pickup_type"), F.when(p % 17 == 0, 1).when(p % 19 == 0, 3).otherwise(0).alias("drop_off_type"))

    def calendar(self) -> DataFrame:
        return self.spark.createDataFrame(CALENDAR, "service_id string, days string, start_date string, end_date string").select("service_id", "days", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))

    def calendar_dates(self) -> DataFrame:
        return self.spark.createDataFrame(EXCEPTIONS, "service_id string, service_date string, exception_type int").withColumn("service_date", F.to_date("service_date"))

    def transfers(self) -> DataFrame:
        return self.spark.createDataFrame(TRANSFERS, "from_stop_id long, to_stop_id long, transfer_type int, min_transfer_time int")

    def feed_info(self) -> DataFrame:
        """No version is given, so that first and last day make one."""
        days = self.calendar().agg(F.min("start_date").alias("feed_start_date"), F.max("end_date").alias("feed_end_date"))
        return days.withColumn("feed_version", F.lit(None).cast("string"))

    def events(self) -> DataFrame:
        return self._read("events")

    def orders_as_alternatives(self) -> DataFrame:
        """Alternatives with many numbers of transfers: customer, arrival, cost, transfers."""
        o = self._read("orders")
        day = F.datediff("o_orderdate", F.lit("1992-01-01"))
        return o.select((F.col("o_custkey") % 100).alias("customer"), (day * 60).alias("arrival"), F.round(F.col("o_totalprice"), 2).alias("cost"), (F.col("o_orderkey") % 23).cast("int").alias("transfers"))

    def observations(self) -> DataFrame:
        """Delays from events: a user is a trip, an event type a stop."""
        e, ts = self._read("events"), F.col("ts")
        return e.select(
            F.col("user_id").alias("trip_id"), F.col("event_type").alias("stop_id"), F.length("event_type").cast("long").alias("stop_sequence"), F.to_date(ts).alias("service_date"),
            F.when(F.col("event_id") % 50 != 0, F.hour(ts) * 3600 + F.minute(ts) * 60).alias("scheduled_arrival"), ts.alias("observed_at"), (F.floor(F.col("value") * 12) - 240).alias("delay_seconds"),
        )

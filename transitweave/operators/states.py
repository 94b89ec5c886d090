"""Search over states: a stop, the trip one has come by, and whether one can get off there.

A label rides on along its trip whether or not one can get off; it walks and changes only where one
can. Boarding another trip asks for a regular pickup and obeys the rules of the stop, also those of
single trips. Each round changes trips once, so labels are told apart by their changes; a
round keeps what no earlier one has reached as early in the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept

_STATE = ["query_id", "stop_id", "trip_id", "can_alight", "required_trip"]


def retained_walks(transfers: DataFrame) -> DataFrame:
    """from_stop_id, to_stop_id, from_trip_id, to_trip_id, seconds: the shortest ways on foot, for walkers who count as having come by their trip all the way.

    All trips that a way asks for must be one; of the trips to take then, the last rule's holds. Rounds double the number of transfers.
    """
    keys = ["from_stop_id", "to_stop_id", "from_trip_id", "to_trip_id"]
    least = F.min("seconds").alias("seconds")
    walks = kept(transfers.where("transfer_type <> 3 AND from_stop_id <> to_stop_id").groupBy(*keys).agg(F.min(F.coalesce("min_transfer_time", F.lit(0))).cast("long").alias("seconds")), "walks")
    while True:
        on = walks.select(F.col("from_stop_id").alias("to_stop_id"), F.col("to_stop_id").alias("end"), F.col("from_trip_id").alias("own"), F.col("to_trip_id").alias("then"), F.col("seconds").alias("more"))
        further = walks.join(on, "to_stop_id").where("from_trip_id IS NULL OR own IS NULL OR from_trip_id = own")
        further = further.select("from_stop_id", F.col("end").alias("to_stop_id"), F.coalesce("from_trip_id", "own").alias("from_trip_id"), F.col("then").alias("to_trip_id"), (F.col("seconds") + F.col("more")).alias("seconds"))
        longer = kept(walks.unionByName(further).groupBy(*keys).agg(least), "walks")
        if longer.exceptAll(walks).isEmpty():
            return longer
        walks = longer


def state_labels(origins: DataFrame, hops: DataFrame, transfers: DataFrame, max_transfers: int = 3, horizon: int = 10800) -> DataFrame:
    """query_id, stop_id, trip_id, can_alight, required_trip, transfers, arrival: the earliest arrival in each state and number of changes, where fewer don't do as well.

    origins: query_id, stop_id, arrival (the time asked for). hops need pickup_type and drop_off_type: one boards and gets off where
    they are 0. transfers: from_stop_id, to_stop_id, transfer_type, min_transfer_time, from_trip_id, to_trip_id. A rule of a
    stop with itself holds for whoever boards another trip there, if it names neither trip or the right ones: of several the
    longest wait, and none may board where one is of type 3. A walk may ask for the trip one has come by, and its to_trip_id for the one to take
    then. A walker still counts as having come by the trip. Departures after the horizon don't count.
    """
    trip_type = hops.schema["trip_id"].dataType
    none = F.lit(None).cast(trip_type)
    walks = retained_walks(transfers)
    few = F.collect_set(F.struct("from_trip_id", "to_trip_id", "transfer_type", F.coalesce("min_transfer_time", F.lit(0)).alias("wait")))
    rules = kept(transfers.where("from_stop_id = to_stop_id").groupBy(F.col("from_stop_id").alias("stop_id")).agg(few.alias("rules")), "stop-rules")  # the rules of a stop are few
    trip = Window.partitionBy("trip_id").orderBy("stop_sequence")
    broken = (F.col("from_stop_id") != F.lag("to_stop_id").over(trip)) | (F.col("departure_seconds") < F.lag("arrival_seconds").over(trip))
    parts = hops.withColumn("part", F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(trip))
    parts = kept(parts.select("trip_id", "part", "stop_sequence", "from_stop_id", "to_stop_id", F.col("departure_seconds").cast("long").alias("departure"), F.col("arrival_seconds").cast("long").alias("reached"), "pickup_type", "drop_off_type"), "parts")
    board = parts.where("pickup_type = 0").select(F.col("from_stop_id").alias("stop_id"), F.col("trip_id").alias("next_trip"), "part", F.col("stop_sequence").alias("from_sequence"), "departure")
    later = parts.select(F.col("trip_id").alias("next_trip"), "part", "stop_sequence", F.col("departure").alias("leaves"), F.col("to_stop_id").alias("next_stop"), "reached", (F.col("drop_off_type") == 0).alias("off"))
    until = origins.groupBy("query_id").agg((F.min("arrival") + horizon).alias("until"))

    def on_foot(labels: DataFrame) -> DataFrame:
        near = labels.where("can_alight").join(walks, F.col("stop_id") == F.col("from_stop_id")).where("from_trip_id IS NULL OR from_trip_id = trip_id")
        walked = near.select("query_id", F.col("to_stop_id").alias("stop_id"), "trip_id", "can_alight", F.col("to_trip_id").alias("required_trip"), (F.col("arrival") + F.col("seconds")).alias("arrival"))
        return labels.unionByName(walked).groupBy(*_STATE).agg(F.min("arrival").alias("arrival"))

    start = origins.select("query_id", "stop_id", none.alias("trip_id"), F.lit(True).alias("can_alight"), none.alias("required_trip"), F.col("arrival").cast("long").alias("arrival"))
    frontier = kept(on_foot(start), "states")
    best, out = frontier, frontier.withColumn("transfers", F.lit(0))
    for k in range(max_transfers + 1):
        boarded = frontier.where("can_alight").join(until, "query_id").join(rules, "stop_id", "left").join(board, "stop_id").where("departure >= arrival AND departure <= until")
        boarded = boarded.where("(trip_id IS NULL OR next_trip <> trip_id) AND (required_trip IS NULL OR next_trip = required_trip)")
        boarded = boarded.withColumn("rules", F.expr("filter(rules, r -> (r.from_trip_id IS NULL OR r.from_trip_id <=> trip_id) AND (r.to_trip_id IS NULL OR r.to_trip_id = next_trip))"))
        boarded = boarded.where("NOT coalesce(exists(rules, r -> r.transfer_type = 3), false) AND departure >= arrival + coalesce(array_max(transform(rules, r -> r.wait)), 0)")
        boarded = boarded.groupBy("query_id", "next_trip", "part", "until").agg(F.min("from_sequence").alias("from_sequence"))
        ridden = boarded.join(later, ["next_trip", "part"]).where("stop_sequence >= from_sequence AND leaves <= until")
        ridden = ridden.select("query_id", F.col("next_stop").alias("stop_id"), F.col("next_trip").alias("trip_id"), F.col("off").alias("can_alight"), none.alias("required_trip"), F.col("reached").alias("arrival"))
        old = best.withColumnRenamed("arrival", "old")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _STATE]
        new = on_foot(ridden).alias("n").join(old.alias("o"), same, "left").where("old IS NULL OR arrival < old").select("n.*")
        frontier = kept(new, "states")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.withColumn("transfers", F.lit(k)))
        best = kept(best.unionByName(frontier).groupBy(*_STATE).agg(F.min("arrival").alias("arrival")), "states")
    return out


def state_arrivals(labels: DataFrame) -> DataFrame:
    """query_id, stop_id, transfers, arrival: where one can get off, with each number of changes that gains time."""
    least = labels.where("can_alight").groupBy("query_id", "stop_id", "transfers").agg(F.min("arrival").alias("arrival"))
    before = F.min("arrival").over(Window.partitionBy("query_id", "stop_id").orderBy("transfers").rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("before", before).where("before IS NULL OR arrival < before").drop("before")

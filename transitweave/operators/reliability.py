"""From delay observations to shrunken profiles on four levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gtfs import EARLY, LATE, shrunken, time_window
from .keep import kept

KEYS = ["trip_id", "stop_id", "stop_sequence", "service_date"]


def deduplicated(observations: DataFrame) -> DataFrame:
    return observations.dropDuplicates([*KEYS, "observed_at"])


def latest(observations: DataFrame) -> DataFrame:
    """The newest observation of each stop visit: one aggregation, combined before the shuffle."""
    rest = [c for c in observations.columns if c not in KEYS]
    newest = observations.groupBy(*KEYS).agg(F.max(F.struct("observed_at", *(c for c in rest if c != "observed_at"))).alias("x"))
    return newest.select(*KEYS, *(F.col(f"x.{c}").alias(c) for c in rest))


def samples(observations: DataFrame, trips: DataFrame) -> DataFrame:
    rows = latest(observations).where("scheduled_arrival IS NOT NULL").join(trips, "trip_id").withColumn("time_window", time_window(F.col("scheduled_arrival")))
    return rows.groupBy("trip_id", "service_date", "route_id", "direction_id", "time_window").agg(F.percentile("delay_seconds", F.lit(0.5)).alias("delay"), F.count(F.lit(1)).alias("stops"), F.max("observed_at").alias("newest"))


def _share(condition) -> F.Column:
    return F.avg(condition.cast("double"))


class Profiles:
    """All levels from one table of samples; each shrinks to the level above.

    Samples are counted once by route, direction and date; the three upper levels come from these
    counts, and distinct dates are counted there. With kept(), each level is computed once and read by all that use it.
    """

    def __init__(self, samples: DataFrame, strength: float = 20.0, minimum: int = 10):
        self.samples = samples.withColumn("ok", F.col("delay").between(EARLY, LATE)).withColumn("direction_key", F.coalesce(F.col("direction_id"), F.lit(-1)))
        self.strength, self.minimum, self._keep, self._levels = strength, minimum, False, {}

    def kept(self) -> Profiles:
        """The same, with samples and levels computed once each."""
        if not self._keep:
            self.samples, self._keep, self._levels = kept(self.samples, "samples"), True, {}
        return self

    def _level(self, name: str, make) -> DataFrame:
        if name not in self._levels:
            self._levels[name] = kept(make(), f"profiles-{name}") if self._keep else make()
        return self._levels[name]

    def _daily(self) -> DataFrame:
        """n and ok of each route, direction and date."""
        counts = [F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok")]
        return self._level("daily", lambda: self.samples.groupBy("route_id", "direction_key", "service_date").agg(*counts))

    def _summed(self, *keys: str) -> DataFrame:
        """n, dates and on_time by keys, from the counts by date."""
        daily = self._daily().groupBy(*keys, "service_date").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
        return daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("service_date").alias("dates"), (F.sum("ok").cast("double") / F.sum("n")).alias("on_time"))

    def _shrunk(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("reliability", shrunken(F.col("n"), F.col("on_time"), F.col("parent"), self.strength)).drop("parent")

    def network(self) -> DataFrame:
        return self._level("network", lambda: self._summed().where("n > 0").withColumn("reliability", F.col("on_time")))

    def route(self) -> DataFrame:
        parent = self.network().select(F.col("reliability").alias("parent"))  # a single row
        return self._level("route", lambda: self._shrunk(self._summed("route_id").crossJoin(F.broadcast(parent))))

    def route_direction(self) -> DataFrame:
        parent = self.route().select("route_id", F.col("reliability").alias("parent"))
        return self._level("route-direction", lambda: self._shrunk(self._summed("route_id", "direction_key").join(parent, "route_id")))

    def exact(self) -> DataFrame:
        return self._level("exact", self._exact)

    def _exact(self) -> DataFrame:
        d = F.col("delay")
        parent = self.route_direction().select("route_id", "direction_key", F.col("reliability").alias("parent"))
        keys = ["route_id", "direction_key", "time_window"]
        rows = self.samples.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), _share(F.col("ok")).alias("on_time"), F.avg(d).alias("mean"), F.avg(F.abs(d)).alias("mean_abs"), F.round(F.stddev_samp(d), 6).alias("stddev"), F.percentile(d, F.lit(0.5)).alias("p50"), F.round(F.percentile(F.abs(d), F.lit(0.9)), 6).alias("p90_abs"), _share(d < EARLY).alias("early"), _share(d > LATE).alias("late")
        )
        dates = self.samples.select(*keys, "service_date").distinct().groupBy(*keys).agg(F.count("service_date").alias("dates"))
        rows = self._shrunk(rows.join(dates, keys).join(parent, ["route_id", "direction_key"]))
        return rows.withColumn("insufficient", F.col("n") < self.minimum)


def resolved(legs: DataFrame, profiles: Profiles) -> DataFrame:
    """Adds level, reliability, n and insufficient to legs (route_id, direction_id, time_window): the most exact profile there is.

    An exact profile of few samples is chosen all the same, and flagged.
    """
    legs = legs.withColumn("direction_key", F.coalesce(F.col("direction_id"), F.lit(-1)))
    pick = lambda df, name, *keys: df.select(*keys, F.struct(F.lit(name).alias("level"), "reliability", "n").alias(name))
    out = legs.join(pick(profiles.exact(), "exact", "route_id", "direction_key", "time_window"), ["route_id", "direction_key", "time_window"], "left")
    out = out.join(pick(profiles.route_direction(), "route_direction", "route_id", "direction_key"), ["route_id", "direction_key"], "left")
    out = out.join(pick(profiles.route(), "route", "route_id"), "route_id", "left").join(F.broadcast(pick(profiles.network(), "network")), how="left")
    best = F.coalesce("exact", "route_direction", "route", "network", F.struct(F.lit("default").alias("level"), F.lit(0.0).alias("reliability"), F.lit(0).cast("long").alias("n")))
    out = out.withColumn("p", best)
    return out.select(*legs.columns, F.col("p.level").alias("level"), F.col("p.reliability").alias("reliability"), F.col("p.n").alias("n"), (F.col("p.n") < profiles.minimum).alias("insufficient"))


def nearest_schedule(observations: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each observation with the stop of its trip whose time is nearest to its own; the smaller sequence wins ties."""
    times = schedule.groupBy("trip_id").agg(F.collect_list(F.struct("arrival_seconds", "stop_sequence")).alias("times"))  # a trip's calls are few
    gaps = F.transform("times", lambda t: F.struct(F.abs(F.col("observed_seconds") - t["arrival_seconds"]).alias("gap"), t["stop_sequence"].alias("stop_sequence")))
    return observations.join(times, "trip_id").withColumn("near", F.array_min(gaps)).select(*observations.columns, "near.stop_sequence", "near.gap")

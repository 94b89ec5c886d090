"""Column functions on service-day seconds, delays, places and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: delay limits in seconds, earth's mean radius in metres, least probability.
EARLY, LATE = -120, 300
EARTH = 6371008.8
FLOOR = 1e-9


def gtfs_seconds(text: Column) -> Column:
    """Seconds of H+:MM:SS, whose hours may pass 24; null where it isn't one."""
    t = F.trim(text)
    part = lambda k: F.split_part(t, F.lit(":"), F.lit(k)).cast("int")
    return F.when(t.rlike(r"^\d+:[0-5]\d:[0-5]\d$"), part(1) * 3600 + part(2) * 60 + part(3))


def format_gtfs(seconds: Column) -> Column:
    s = F.abs(seconds)
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def time_window(seconds: Column) -> Column:
    """The part of the day of a service-day second; null for null."""
    h = F.floor(seconds / 3600) % 24
    return F.when(h < 6, "overnight").when(h < 10, "morning_peak").when(h < 15, "midday").when(h < 19, "afternoon_peak").when(h < 24, "evening")


def delay_class(seconds: Column) -> Column:
    return F.when(seconds < EARLY, "early").when(seconds > LATE, "late").when(seconds.isNotNull(), "on_time")


def haversine_meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Null where a coordinate is missing, not finite or out of range."""
    good = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)
    return F.when(good, haversine_meters(lat1, lon1, lat2, lon2) / 1000)


def heuristic_seconds(km: Column, max_speed_kmh: float = 120.0) -> Column:
    return F.coalesce(km / F.lit(max_speed_kmh) * 3600, F.lit(0.0))


def route_name(short: Column, long: Column, route_id: Column) -> Column:
    return F.coalesce(short, long, route_id.cast("string"))


def shrunken(n: Column, share: Column, parent: Column, strength: float = 20.0) -> Column:
    n = n.cast("double")
    return n / (n + F.lit(strength)) * share + F.lit(strength) / (n + F.lit(strength)) * parent


def leg_cost(p: Column) -> Column:
    """-ln of a probability, not under the least one; a missing one counts as the least."""
    return -F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(FLOOR)))


def percent_score(reliability: Column, duration: Column, fastest: Column, transfers: Column, weights: tuple[float, float, float] = (0.5, 0.5, 0.0)) -> Column:
    """0 to 100: reliability, speed against the fastest, and few transfers, by weights."""
    if min(weights) < 0 or not sum(weights):
        raise ValueError("weights must not be negative, and not all 0")
    r, s, t = (w / sum(weights) for w in weights)
    speed = F.least(F.lit(1.0), fastest.cast("double") / F.greatest(F.lit(1), duration))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (r * reliability + s * speed + t / (1 + transfers.cast("double")))))


def folded(text: Column) -> Column:
    """Lower case for comparisons; a sharp s counts as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))

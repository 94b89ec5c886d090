"""Ranking of itineraries by transfers that hold, legs on time, and speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the domain: the weights of the score.
COMPLETION, ADHERENCE, SPEED = 0.55, 0.25, 0.20


def simulation_score(completion: Column, adherence: Column, duration: Column, fastest: Column) -> Column:
    """0 to 100: transfers that hold, legs on time, and speed against the fastest."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    ratio = F.when(duration <= 0, F.lit(1.0)).otherwise(unit(fastest.cast("double") / duration))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (COMPLETION * unit(completion) + ADHERENCE * unit(adherence) + SPEED * ratio)))


def simulation_ranking(itineraries: DataFrame, group: list[str]) -> DataFrame:
    """itineraries (itinerary_id, departure, arrival, completion, adherence) with score and rank in their group."""
    rows = itineraries.withColumn("duration", F.col("arrival") - F.col("departure"))
    rows = rows.withColumn("fastest", F.min("duration").over(Window.partitionBy(*group)))
    rows = rows.withColumn("score", F.round(simulation_score(F.col("completion"), F.col("adherence"), F.col("duration"), F.col("fastest")), 6))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("completion"), "arrival", "itinerary_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("fastest", "duration")

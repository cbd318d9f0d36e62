"""Percentiles of the time from event to result, per decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import quantiles
from ledgerlens.operators.evaluations import latencies
from ledgerlens.session import if_small, materialize


def latency_percentiles(deliveries: DataFrame, probabilities=(0.5, 0.9, 0.95, 0.99), bits: int | None = None) -> DataFrame:
    """(decision, p, value, count) over kept copies with decision and processing time."""
    return quantiles.percentiles(quantiles.value_counts(latencies(deliveries), ["decision"], "latency", bits), ["decision"], probabilities)


def slow_evaluations(deliveries: DataFrame, times: int = 10) -> DataFrame:
    """Kept copies whose latency is more than `times` the median of their decision. The median
    table has one row per decision; its size is checked before it is broadcast."""
    every = materialize(latencies(deliveries), "latencies")
    medians = quantiles.percentiles(quantiles.value_counts(every, ["decision"], "latency"), ["decision"], [0.5])
    m = medians.select(F.col("decision").alias("_d"), F.col("value").alias("_median"))
    hit = every.join(if_small(m), F.col("decision") == F.col("_d"))
    return hit.where(F.col("latency") > F.col("_median") * times).select("evaluation_id")

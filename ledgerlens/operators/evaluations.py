"""Deliveries of scoring results: the kept copy of every evaluation and what builds on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ingested_at", "source_partition", "source_offset")


def kept_copies(deliveries: DataFrame, *columns: str) -> DataFrame:
    """The row of each evaluation_id (null and empty ones left out) with the smallest
    (ingested_at, source_partition, source_offset), nulls last. Copies are reduced on the map side first."""
    real = deliveries.where(F.col("evaluation_id") != "")
    order = F.struct(*[x for c in ORDER for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    best = real.groupBy("evaluation_id").agg(F.min_by(F.struct(*columns), order).alias("_k"))
    return best.select("evaluation_id", *[F.col(f"_k.{c}").alias(c) for c in columns])


def latencies(deliveries: DataFrame) -> DataFrame:
    """(evaluation_id, decision, latency) of kept copies with decision and processing time."""
    k = kept_copies(deliveries, "decision", "event_time", "processed_at")
    k = k.where(F.col("decision").isNotNull() & F.col("processed_at").isNotNull() & F.col("event_time").isNotNull())
    return k.select("evaluation_id", "decision", F.try_subtract("processed_at", "event_time").alias("latency")).where(F.col("latency").isNotNull())

"""Deliveries of payments: usable event times and counted payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AHEAD_MS = 300_000


def usable_event_time(event_time: str = "event_time", producer_time: str = "producer_time") -> Column:
    """Not null, above 0 and at most five minutes ahead of the producer's clock (false if that is null)."""
    t, p = F.col(event_time), F.col(producer_time)
    return F.coalesce((t > 0) & (F.try_subtract(t, F.lit(AHEAD_MS)) <= p), F.lit(False))  # whatever the times, nothing overflows


def counted_payments(deliveries: DataFrame, *columns: str) -> DataFrame:
    """One row per event_id with a usable event time and a customer that is neither null nor
    blank, with the given columns.

    Copies of a payment agree in all fields but producer_time, so the distinct rows of
    (event_id, columns) are the payments: Spark drops copies on the map side before the
    exchange, and no copy count can make a partition large. A payment is counted if any of its
    copies has a usable time. Rows without event_id cannot be told apart and are left out; if
    copies disagreed in a requested field, each version would count.
    """
    return (
        deliveries.where(usable_event_time() & F.col("event_id").isNotNull() & (F.trim("customer_id") != ""))
        .select("event_id", *columns)
        .distinct()
    )

"""Per-period aggregates by event time, corrected by late records up to a cut-off.

Deliveries arrive in the order of their offsets within a partition of the source. A run of
`batch_rows` offsets is an arrival batch. Every batch stores mergeable partial aggregates per
period; reading combines them, and a later batch corrects a period by adding its own
partials. A record older than the frontier (the highest usable event time of all smaller
offsets of its partition) by the cut-off or more meets a closed period and is refused.

Which periods are closed to a batch is read from the stored partials (`arrivals`, `closings`):
the maxima of earlier batches are the frontier at its start, and the lowest and highest time of
each of its partials say whether all records of a period are refused (CLOSED), none (OPEN) or
whether the period closes while the batch arrives (CLOSING). Only batches with a closing period
are looked into again, by a running maximum inside the batch. No step runs over a whole
partition of the source: maxima of batches are combined in runs of RUN batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.payments import usable_event_time
from ledgerlens.session import if_small, materialize

CUTOFF_MS = 7_200_000
PERIOD_MS = 3_600_000
BATCH_ROWS = 16_384
RUN = 4_096
FIELDS = ("event_id", "customer_id", "amount_minor")
_BATCH = ("source_partition", "arrival_batch")


def _period(period_ms: int) -> Column:
    return F.col("event_time") - F.pmod("event_time", F.lit(period_ms))


def _placed(deliveries: DataFrame, batch_rows: int, period_ms: int, columns: tuple[str, ...]) -> DataFrame:
    at = ("source_partition", "source_offset", "event_time")
    rows = deliveries.where(F.col("source_partition").isNotNull() & F.col("source_offset").isNotNull())
    return rows.select(
        "source_partition", F.expr(f"source_offset div {int(batch_rows)}").alias("arrival_batch"), "source_offset", "event_time",
        usable_event_time().alias("usable"), F.when(usable_event_time(), _period(period_ms)).alias("period_start"), *[c for c in columns if c not in at],
    )


def arrivals(deliveries: DataFrame, period_ms: int = PERIOD_MS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Mergeable partials of what arrived: (source_partition, arrival_batch, period_start, deliveries,
    low, high), one row per batch and period of usable event times."""
    rows = _placed(deliveries, batch_rows, period_ms, ()).where("usable")
    return rows.groupBy(*_BATCH, "period_start").agg(F.count(F.lit(1)).alias("deliveries"), F.min("event_time").alias("low"), F.max("event_time").alias("high"))


def _frontiers(tops: DataFrame) -> DataFrame:
    """(source_partition, arrival_batch, top, start): the highest time of all earlier batches of
    the partition, by running maxima in runs of batches and over runs."""
    runs = tops.withColumn("_run", F.expr(f"arrival_batch div {RUN}"))
    inside = Window.partitionBy("source_partition", "_run").orderBy("arrival_batch").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source_partition").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy("source_partition", "_run").agg(F.max("top").alias("_top")).select("source_partition", "_run", F.max("_top").over(over).alias("_before"))
    both = runs.withColumn("_in", F.max("top").over(inside)).join(before, ["source_partition", "_run"])
    return both.select(*_BATCH, "top", F.greatest("_in", "_before").alias("start"))


def closings(partials: DataFrame, cutoff_ms: int = CUTOFF_MS, reached: DataFrame | None = None) -> DataFrame:
    """The partials of `arrivals` with start, the frontier before their batch, and state: CLOSED,
    OPEN or CLOSING. reached: (source_partition, top), the highest usable time before all of them."""
    at = _frontiers(partials.groupBy(*_BATCH).agg(F.max("high").alias("top")))
    if reached is not None:
        r = reached.select(F.col("source_partition").alias("_p"), F.col("top").alias("_reached"))
        at = at.join(r, F.col("source_partition") == F.col("_p"), "left").withColumn("start", F.greatest("start", "_reached")).drop("_p", "_reached")
    end = F.greatest("start", "top")
    cut = F.lit(cutoff_ms)
    state = F.when(F.col("high") <= F.col("start") - cut, "CLOSED").when(F.col("low") > end - cut, "OPEN").otherwise("CLOSING")
    return partials.join(at, list(_BATCH)).withColumn("state", state).drop("top")


def admit(
    deliveries: DataFrame,
    *columns: str,
    cutoff_ms: int = CUTOFF_MS,
    batch_rows: int = BATCH_ROWS,
    period_ms: int = PERIOD_MS,
    reached: DataFrame | None = None,
) -> DataFrame:
    """Deliveries with source_partition, source_offset, event_time, arrival_batch, period_start,
    usable and refused, besides the given columns.

    Nulls: rows without partition or offset have no place in the order and are left out; an
    unusable event time neither moves the frontier nor is it refused. Offsets are unique within a
    partition; of equal ones, one would see the other's time. An empty table gives an empty result.
    """
    stored = materialize(arrivals(deliveries, period_ms, batch_rows), "arrivals")
    states = closings(stored, cutoff_ms, reached).select(*_BATCH, "period_start", "start", "state")
    # a row per batch and period
    states = materialize(states.withColumn("_look", F.max((F.col("state") == "CLOSING").cast("int")).over(Window.partitionBy(*_BATCH))), "states")
    # every usable delivery has a partial; the others move nothing and are not refused
    rows = _placed(deliveries, batch_rows, period_ms, columns).join(if_small(states), [*_BATCH, "period_start"], "left")
    out = ["source_partition", "source_offset", "event_time", "arrival_batch", "period_start", "usable", *[c for c in columns if c not in ("source_partition", "source_offset", "event_time")]]
    closed = F.coalesce(F.col("state") == "CLOSED", F.lit(False))
    # batches without a closing period are settled by their states alone, and are not exchanged
    settled = rows.where(F.coalesce("_look", F.lit(0)) == 0).select(*out, closed.alias("refused"))
    within = Window.partitionBy(*_BATCH).orderBy("source_offset").rowsBetween(Window.unboundedPreceding, -1)
    frontier = F.greatest(F.max("event_time").over(within), F.col("start"))
    late = (F.col("state") == "CLOSING") & (F.col("event_time") <= frontier - F.lit(cutoff_ms))
    looked = rows.where("_look = 1").select(*out, (closed | F.coalesce(late, F.lit(False))).alias("refused"))
    return settled.unionByName(looked)


def refused_deliveries(deliveries: DataFrame, cutoff_ms: int = CUTOFF_MS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The deliveries that came after their period was closed for them."""
    return admit(deliveries, cutoff_ms=cutoff_ms, batch_rows=batch_rows).where("refused").select("source_partition", "source_offset")


def accepted(admitted: DataFrame) -> DataFrame:
    """(event_id, event_time, amount_minor, source_partition, arrival_batch) of the counted payments
    at their first accepted delivery. Amounts that are null or outside 1..10^12 become null: such
    a payment counts without amount."""
    amount = F.when(F.col("amount_minor").between(1, 1_000_000_000_000), F.col("amount_minor"))
    good = admitted.where(F.col("usable") & ~F.col("refused") & F.col("event_id").isNotNull() & (F.trim("customer_id") != ""))
    first = (
        good.select("event_id", "event_time", amount.alias("amount_minor"), F.struct("source_offset", "source_partition", "arrival_batch").alias("_at"))
        .groupBy("event_id", "event_time", "amount_minor")
        .agg(F.min("_at").alias("_at"))
    )
    return first.select("event_id", "event_time", "amount_minor", "_at.source_partition", "_at.arrival_batch")


def partial_aggregates(payments: DataFrame, period_ms: int = PERIOD_MS) -> DataFrame:
    """Mergeable partials (period_start, source_partition, arrival_batch, n, amount_minor) of accepted payments."""
    return payments.groupBy(_period(period_ms).alias("period_start"), *_BATCH).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("amount_minor"))


def combine(*partials: DataFrame) -> DataFrame:
    """Merges partials of any batches into (period_start, n, amount_minor). Associative: its
    own result may be merged again with the partials of later batches."""
    cols = ["period_start", "n", "amount_minor"]
    every = partials[0].select(*cols)
    for p in partials[1:]:
        every = every.unionByName(p.select(*cols))
    return every.groupBy("period_start").agg(F.sum("n").alias("n"), F.sum("amount_minor").alias("amount_minor"))


def hourly(deliveries: DataFrame, **settings: int) -> DataFrame:
    """Counts and amounts per hour of event time, late payments included up to the cut-off: the
    stored partials of all batches, combined."""
    return combine(materialize(partial_aggregates(accepted(admit(deliveries, *FIELDS, **settings))), "partials"))

"""What each payment's customer did in the time before it, per rule of a policy.

A rule looks back over the half-open stretch (t - window, t] of its customer's earlier
payments; earlier means a smaller (event_time, event_id), so that of payments at the same time
those with a smaller event_id count as history. No single frame can say that; it is the
difference of two, all earlier payments (ROWS) and those that have left the window (RANGE). Both
begin with the partition, so that Spark carries their sums along, and a burst of payments costs
no more than as many payments apart. Distinct devices are sums too: of devices met, left and
come back.

A customer may hold a third of all payments. Payments are therefore partitioned by (customer,
cell of time) instead of customer, and each cell is given a halo: the payments of the stretch
before it that its windows can reach. Halo rows feed frames and are dropped afterwards. When a
device was last seen, however long ago, comes from the maxima per (customer, device, cell), a
small table with a running maximum over cells, and a frame inside the cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.policy import TYPES, Rule

CELL_MS = 86_400_000  # of the time that a device was last seen
CELLS = 4


def _cells(payments: DataFrame, reach_ms: int, cell_ms: int) -> DataFrame:
    """Every payment in its own cell (_own) and as halo in those of the next reach_ms."""
    lo, hi = F.floor(F.col("event_time") / cell_ms), F.floor((F.col("event_time") + reach_ms) / cell_ms)
    return payments.withColumn("_cell", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_cell") == lo)


def last_seen(payments: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """payments with last_seen: the latest earlier time of the same customer and device, or null."""
    keys = ["customer_id", "device_id"]
    p = payments.withColumn("_c", F.floor(F.col("event_time") / cell_ms))
    before_cells = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = p.groupBy(*keys, "_c").agg(F.max("event_time").alias("_top")).select(*keys, "_c", F.max("_top").over(before_cells).alias("_start"))
    within = Window.partitionBy(*keys, "_c").orderBy("event_time", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = p.withColumn("_in", F.max("event_time").over(within))
    return inside.join(tops, [*keys, "_c"], "left").withColumn("last_seen", F.coalesce("_in", "_start")).drop("_c", "_in", "_start")


def observations(payments: DataFrame, rules: Sequence[Rule], cell_ms: int | None = None) -> DataFrame:
    """payments with o_<rule_id>, e_<rule_id> and m_<rule_id> (observed, eligible, matched) per
    rule. Rules of one kind and window share their frames. Disabled rules are observed too, but
    never matched. Needs event_id, customer_id, device_id, amount_minor, currency, status,
    event_time, none of them null; event_ids are distinct.

    cell_ms: the length of a cell, CELLS windows of the longest rule if None."""
    windows = [r.window_seconds * 1000 for r in rules if r.type != "NEW_DEVICE_HIGH_AMOUNT"]
    df = last_seen(payments) if any(r.type == "NEW_DEVICE_HIGH_AMOUNT" for r in rules) else payments
    df = _cells(df, max(windows, default=1) - 1, cell_ms or CELLS * max(windows, default=CELL_MS // CELLS))
    key = ["customer_id", "_cell"]
    order = Window.partitionBy(*key).orderBy("event_time", "event_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    times = Window.partitionBy(*key).orderBy("event_time")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))

    def within(what: Column, w: int) -> Column:
        """The sum over earlier payments in the window: all earlier ones less those that have left it. Both
        sums only grow along the order, so that a window costs the same however many payments it holds."""
        return zero(F.sum(what).over(before)) - zero(F.sum(what).over(times.rangeBetween(Window.unboundedPreceding, -w)))

    device_windows = {r.window_seconds * 1000 for r in rules if r.type == "UNIQUE_DEVICES"}
    if device_windows:
        # both partitionings below are served by this exchange
        same = Window.partitionBy(*key, "device_id").orderBy("event_time", "event_id")
        df = df.repartition(*key).withColumns({"_prev": F.lag("event_time").over(same), "_next": F.lead("event_time").over(same)})
    one, declined = F.lit(1), F.when(F.col("status") == "DECLINED", 1).otherwise(0)
    amount, t = F.col("amount_minor"), F.col("event_time")
    out: dict[str, Column] = {}
    for r in rules:
        w = r.window_seconds * 1000
        eligible: Column = F.lit(True)
        if r.type == "TX_COUNT_VELOCITY":
            seen = within(one, w) + 1
        elif r.type == "AMOUNT_VELOCITY":
            seen = amount + within(F.when(F.col("currency") == r.currency, amount), w)
            eligible = F.col("currency") == r.currency
        elif r.type == "UNIQUE_DEVICES":
            # devices met so far, less those whose last payment has left the window, plus those that came back since
            met = F.sum(F.when(F.col("_prev").isNull(), 1).otherwise(0)).over(upto)
            back = F.sum(F.when(t - F.col("_prev") >= w, 1).otherwise(0)).over(upto)
            left = F.sum(F.when(F.col("_next").isNull() | (F.col("_next") - t >= w), 1).otherwise(0)).over(times.rangeBetween(Window.unboundedPreceding, -w))
            seen = met + back - zero(left)
        elif r.type == "NEW_DEVICE_HIGH_AMOUNT":
            seen = amount
            eligible = F.col("last_seen").isNull() | (F.col("last_seen") <= t - w)
        elif r.type == "DECLINE_THEN_APPROVAL":
            seen = within(declined, w)
            eligible = F.col("status") == "APPROVED"
        else:
            raise ValueError(f"unknown kind of rule {r.type}")
        out[f"o_{r.rule_id}"], out[f"e_{r.rule_id}"] = seen, eligible
    df = df.withColumns(out)
    hits = {}
    for r in rules:
        o = F.col(f"o_{r.rule_id}")
        hits[f"m_{r.rule_id}"] = F.lit(r.enabled) & F.col(f"e_{r.rule_id}") & (o > r.threshold if TYPES[r.type] == ">" else o >= r.threshold)
    return df.withColumns(hits).where("_own").drop("_own", "_cell", "last_seen", "_prev", "_next")

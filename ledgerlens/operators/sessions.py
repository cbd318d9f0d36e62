"""Sessions by inactivity gap, as merging interval state.

Every event opens an interval that reaches `gap_ms` beyond its time, [started_at, until];
intervals of a key that overlap or touch are one session. The state is a set of disjoint
intervals per key and cell of time, merged as events arrive:

* `Intervals.opened` makes the intervals and `merged` merges those of a cell (key, stretch of time),
  which splits a key that holds a third of all rows over many tasks;
* a later batch merges into the stored state by the same function, in the cells that it touches; a
  batch of late events is no exception;
* `read` makes sessions of the state: intervals that reach their cell's edge, at most two per
  cell, merge per key with those of neighbouring cells; a session is final once the watermark has
  passed its `until`.

Merging is associative, so that batches in any order give the same sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import late_periods
from ledgerlens.operators.payments import usable_event_time
from ledgerlens.session import materialize

GAP_MS = 1_800_000
CELL_MS = 86_400_000
TOP = (1 << 63) - 1


def merge_intervals(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., started_at, ended_at, until, n): intervals of a key that overlap or touch become one."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("started_at", "until")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("started_at") > reached), 1).otherwise(0)
    numbered = state.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of = [F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("until").alias("until"), F.sum("n").alias("n")]
    return numbered.groupBy(*keys, "_session").agg(*of).drop("_session")


class Intervals:
    """Interval state of sessions: one row per disjoint interval of a key within a cell, in the
    columns of `named` (the keys), _cell, started_at, ended_at (the last event), until and n.

    Rows with a null key or time are left out; other columns are ignored; an empty table gives
    no sessions. Near the end of the 64-bit range an interval ends with the range."""

    def __init__(self, keys: Sequence[str], gap_ms: int = GAP_MS, cell_ms: int = CELL_MS):
        if cell_ms <= 2 * gap_ms:
            raise ValueError("a cell must be longer than two gaps")
        self.keys, self.gap_ms, self.cell_ms = list(keys), gap_ms, cell_ms
        self.named = [f"_key{i}" for i in range(len(self.keys))]  # so that no input column can clash

    def opened(self, events: DataFrame, time: str = "event_time", *by: str) -> DataFrame:
        """The interval of every key and time of events, and of every value of other columns (`by`), which
        must not be null."""
        rows = events.select(*[F.col(k).alias(v) for k, v in zip(self.keys, self.named)], *by, F.col(time).cast("bigint").alias("started_at")).dropna()
        points = rows.groupBy(*self.named, *by, "started_at").agg(F.count(F.lit(1)).alias("n"))
        until = F.coalesce(F.try_add("started_at", F.lit(self.gap_ms)), F.lit(TOP))
        return points.withColumns({"ended_at": F.col("started_at"), "until": until, "_cell": F.floor(F.col("started_at") / F.lit(self.cell_ms))})

    def merged(self, *states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """One state of several: intervals merge within their key and cell, and values of `by`."""
        every = states[0]
        for s in states[1:]:
            every = every.unionByName(s)
        return merge_intervals(every, [*self.named, "_cell", *by])

    def read(self, state: DataFrame, watermark: int | None = None) -> DataFrame:
        """(keys..., started_at, ended_at, duration_ms, n, final): sessions across cells. A session is
        final if the watermark has passed it, and all are without one."""
        lower = F.try_multiply("_cell", F.lit(self.cell_ms))
        edge = (F.try_subtract("started_at", lower) <= self.gap_ms) | (F.try_subtract("until", lower) >= self.cell_ms)
        edge = F.coalesce(edge, F.lit(True))  # at the ends of the 64-bit range
        # one exchange for both kinds: an inner interval has its start as a key of its own and stays as it is
        local = state.withColumn("_own", F.when(edge, F.lit(None).cast("bigint")).otherwise(F.col("started_at"))).drop("_cell")
        whole = merge_intervals(local, [*self.named, "_own"])
        final = F.col("until") < F.lit(watermark) if watermark is not None else F.lit(True)
        names = [F.col(v).alias(c) for c, v in zip(self.keys, self.named)]
        return whole.select(*names, "started_at", "ended_at", F.try_subtract("ended_at", "started_at").alias("duration_ms"), "n", final.alias("final"))


def sessions(events: DataFrame, keys: Sequence[str], time: str = "event_time", gap_ms: int = GAP_MS, cell_ms: int = CELL_MS) -> DataFrame:
    """(keys..., started_at, ended_at, duration_ms, n) of one batch of events. A new session starts
    when more than gap_ms have passed since the previous event; events at the same time belong together."""
    i = Intervals(keys, gap_ms, cell_ms)
    return i.read(i.merged(i.opened(events, time))).drop("final")


def device_sessions(deliveries: DataFrame, gap_ms: int = GAP_MS, cell_ms: int = CELL_MS, lateness_ms: int = late_periods.CUTOFF_MS) -> DataFrame:
    """Sessions of the counted payments per customer and device (null devices left out).

    The payments that arrived behind the watermark of their source partition (the highest usable
    time before them less lateness_ms) are a late batch: the others make the state, which is
    written, and the late ones merge into it. A payment is late if all its copies are; deliveries
    without coordinates are taken as on time."""
    fields = ["event_id", "customer_id", "device_id", "event_time"]
    at = late_periods.admit(deliveries, *fields, cutoff_ms=lateness_ms).where("usable").select(*fields, "refused")
    lost = deliveries.where(F.col("source_partition").isNull() | F.col("source_offset").isNull()).where(usable_event_time())
    counted = at.unionByName(lost.select(*fields, F.lit(False).alias("refused"))).where(F.col("event_id").isNotNull() & F.col("device_id").isNotNull() & (F.trim("customer_id") != ""))
    paid = counted.groupBy(*fields).agg(F.min("refused").alias("late"))
    i = Intervals(["customer_id", "device_id"], gap_ms, cell_ms)
    # both batches are written at once, each merged by itself
    state = materialize(i.merged(i.opened(paid, "event_time", "late"), by=["late"]), "intervals", compression="zstd")
    return i.read(i.merged(state.where("NOT late").drop("late"), state.where("late").drop("late"))).drop("final")

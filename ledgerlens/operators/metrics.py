"""Counters of a running job, and the conditions that raise an alert."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

RULES = ("R001", "R002", "R003", "R004", "R005")


def observed(df: DataFrame, name: str, kind: str = "kind") -> tuple[DataFrame, Observation]:
    """df with counters that Spark fills while it runs, without a pass of its own: rows, valid, invalid,
    late and conflicting ones, decisions by result and the amount of them, matches by rule and the time
    from event to decision. Of a stream, they come with every progress report. Columns that df
    lacks are counted as 0."""
    o, has = Observation(name), set(df.columns)
    of: Column = F.col(kind)
    d = F.col("decision") if "decision" in has else F.lit(None).cast("string")
    delay = F.greatest(F.lit(0), F.try_subtract("processed_at", "event_time")) if {"processed_at", "event_time"} <= has else F.lit(None).cast("bigint")
    counters = [
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(of == k).alias(k.lower()) for k in ("FIRST", "INVALID", "CONFLICT", "LATE")],
        *[F.count_if(d == x).alias(x.lower()) for x in ("APPROVE", "REVIEW", "REJECT")],
        F.coalesce(F.sum(F.when(d.isNotNull(), F.col("amount_minor"))), F.lit(0)).alias("amount_minor"),
        *[(F.count_if(F.array_contains("matched_rules", r)) if "matched_rules" in has else F.lit(0).cast("bigint") + F.count_if(F.lit(False))).alias(f"matches_{r}") for r in RULES],
        F.coalesce(F.max(F.when(d.isNotNull(), delay)), F.lit(0)).alias("slowest_ms"),
    ]
    return df.observe(o, *counters), o


def alerts(counters: dict[str, float], limits: dict[str, float]) -> list[str]:
    """The names of counters above their limit, in order; a counter that is missing raises its alert too."""
    return sorted(k for k, most in limits.items() if counters.get(k) is None or counters[k] > most)


@dataclass(frozen=True)
class Alert:
    """A counter's increase over `window_s`, a second if rate, above `limit` for at least `for_s`."""

    name: str
    counter: str
    limit: float
    window_s: int = 300
    rate: bool = False
    for_s: int = 0


# The alerts of a running job and their limits
ALERTS = (
    Alert("invalid_input", "invalid", 1, rate=True, for_s=300),
    Alert("late_input", "late", 1, rate=True, for_s=300),
    Alert("rejected_decision", "rejected", 0),
    Alert("pending_payments", "overdue", 0),
    Alert("integrity_conflict", "conflict", 0),
)


def raised(events: DataFrame, at: str, counter: str, alert: Alert) -> DataFrame:
    """(time, value, raised): an alert over a log of events with a time in ms and a counter column, per
    window that has any: the increase, or rate, of the window, and whether it is above the limit, and
    was so in all windows of the last for_s before it too."""
    w = alert.window_s * 1000
    per = events.where(F.col(at).isNotNull()).groupBy((F.floor(F.col(at) / w) * w).alias("time")).agg(F.sum(F.col(counter).cast("bigint")).alias("n"))
    value = F.col("n") / alert.window_s if alert.rate else F.col("n").cast("double")
    over = per.select("time", value.alias("value"), (value > alert.limit).alias("_over"))
    # a window above the limit counts for itself and for those after it that look back on it
    back = -(-alert.for_s // alert.window_s)
    counted = over.where("_over").select(F.explode(F.sequence(F.col("time"), F.col("time") + back * w, F.lit(w))).alias("_time")).groupBy("_time").agg(F.count(F.lit(1)).alias("_n"))
    held = over.join(counted, F.col("time") == F.col("_time"), "left")
    return held.select("time", "value", F.coalesce(F.col("_over") & (F.col("_n") == back + 1), F.lit(False)).alias("raised"))


class Watchdog(StreamingQueryListener):
    """Looks after streams that hold payments back: a query whose state has rows and whose watermark has
    not moved for alert_ms (by the times of its progress reports) is counted in `overdue`."""

    def __init__(self, alert_ms: int = 60_000):
        self.alert_ms, self.overdue = alert_ms, 0
        self.moved: dict[str, tuple[str, float]] = {}

    def look(self, query: str, watermark: str, at_ms: float, state_rows: int) -> bool:
        """Takes in a report; whether what waits is overdue."""
        known, since = self.moved.get(query, (None, at_ms))
        if known != watermark:
            self.moved[query], since = (watermark, at_ms), at_ms
        late = state_rows > 0 and at_ms - since > self.alert_ms
        self.overdue += late
        return late

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        from datetime import datetime

        p = json.loads(event.progress.json)
        at = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).timestamp() * 1000
        self.look(str(p["id"]), p.get("eventTime", {}).get("watermark", ""), at, sum(s["numRowsTotal"] for s in p.get("stateOperators", [])))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.moved.pop(str(event.id), None)

"""Dashboard reads over summary rows: totals, series, rule matches, latest rows, pages."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import nearest_ranks

WINDOWS = {"15m": 900, "1h": 3_600, "24h": 86_400}
BUCKETS, PAGE, LATEST = 30, 20, 100


def within(rows: DataFrame, anchor_ms: int, window: str) -> DataFrame:
    """Rows processed in the window before the anchor; the anchor is a parameter, not a clock."""
    return rows.where(F.col("processed_at") >= F.lit(anchor_ms - WINDOWS[window] * 1000))


def _by_decision() -> list[Column]:
    d = F.col("decision")
    return [F.count_if(d == "APPROVE").alias("approved"), F.count_if(d == "REVIEW").alias("review"), F.count_if(d == "REJECT").alias("rejected")]


def totals(rows: DataFrame) -> DataFrame:
    """One row, zeros if there is none; finalization_p95 is the exact nearest-rank percentile of the
    time from event to decision. rows are read twice: they should come from a written table."""
    sums = rows.agg(F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("amount_minor"), *_by_decision())
    delay = F.greatest(F.lit(0), F.try_subtract("processed_at", "event_time"))
    p95 = nearest_ranks(rows.select(F.lit(0).alias("_g"), F.when(F.col("processed_at").isNotNull() & F.col("event_time").isNotNull(), delay).alias("_v")), "_g", "_v", [0.95]).select(F.col("value").alias("finalization_p95"))
    both = sums.unionByName(p95, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*sums.columns, "finalization_p95")])


def bucket_ms(window: str) -> int:
    return WINDOWS[window] // BUCKETS * 1000


def series(rows: DataFrame, window: str) -> DataFrame:
    """Counts per bucket of a thirtieth of the window; buckets without rows are absent."""
    b = bucket_ms(window)
    return rows.groupBy((F.floor(F.col("processed_at") / b) * b).alias("time")).agg(*_by_decision())


def series_filled(rows: DataFrame, window: str, anchor_ms: int) -> DataFrame:
    """The same with zeros for all 31 buckets up to the anchor's."""
    b = bucket_ms(window)
    last = anchor_ms // b * b
    times = rows.sparkSession.range(last - BUCKETS * b, last + 1, b).select(F.col("id").alias("time"))
    return times.join(series(rows, window), "time", "left").na.fill(0, ["approved", "review", "rejected"])


def rule_matches(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("matched_rules").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("matches"))


def latest(rows: DataFrame, n: int = LATEST) -> DataFrame:
    """The n rows processed last, those without a time left out: a top-k, not a sort."""
    return rows.where(F.col("processed_at").isNotNull()).orderBy(F.desc("processed_at"), "transaction_id").limit(n)


def shares(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(F.try_divide(F.count_if(F.col("decision") == "APPROVE") * 100.0, n).alias("approval_percent"), F.count_if(F.col("decision").isin("REVIEW", "REJECT")).alias("flagged"))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows of which an id, the customer or a rule holds the text, whatever its case."""
    hay = F.lower(F.concat_ws(" ", "transaction_id", "event_id", "customer_id", F.concat_ws(" ", "matched_rules")))
    return rows.where(hay.contains(text.lower()))


def customers(rows: DataFrame) -> DataFrame:
    d = F.col("decision")
    return rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("payments"), F.count_if(d != "APPROVE").alias("alerts"), F.max("risk_score").alias("max_score"), F.max("event_time").alias("last_event"), *_by_decision())


class CursorError(ValueError):
    pass


def encode_cursor(scope: str, **at: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"scope": scope, **at}, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, scope: str, types: dict[str, type]) -> dict[str, object] | None:
    """The position in a cursor, None for an empty one; an altered cursor or one of another scope is refused."""
    if not cursor:
        return None
    try:
        at = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if at.pop("scope") != scope or set(at) != set(types) or any(type(at[k]) is not t for k, t in types.items()):
            raise CursorError("invalid cursor")
        return at
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        raise CursorError("invalid cursor") from e


def customers_page(rows: DataFrame, prefix: str = "", decision: str = "ALL", after: str = "", size: int = PAGE) -> DataFrame:
    """A page of customers by id, and one row more that tells whether there is another. The prefix
    and the position are filters on the grouping key, and reach the scan."""
    few = rows.where(F.col("customer_id").startswith(prefix) & (F.col("customer_id") > after))
    c = customers(few)
    if decision != "ALL":
        c = c.where(F.col({"APPROVE": "approved", "REVIEW": "review", "REJECT": "rejected"}[decision]) > 0)
    return c.orderBy("customer_id").limit(size + 1)


def timeline_page(rows: DataFrame, customer: str, after: tuple[int, str] | None = None, size: int = PAGE) -> DataFrame:
    """A customer's decisions, newest first, after the position (event_time, evaluation_id)."""
    mine = rows.where(F.col("customer_id") == customer)
    if after:
        t, i = after
        mine = mine.where((F.col("event_time") < t) | ((F.col("event_time") == t) & (F.col("evaluation_id") < i)))
    return mine.orderBy(F.desc("event_time"), F.desc("evaluation_id")).limit(size + 1)


def page(rows: DataFrame, scope: str, key: Sequence[str], size: int = PAGE) -> tuple[list[dict], str | None]:
    """(items, next cursor) of a page that was read with one row more."""
    got = [r.asDict(recursive=True) for r in rows.collect()]  # size + 1 rows at most
    more = len(got) > size
    return got[:size], encode_cursor(scope, **{k: got[size - 1][k] for k in key}) if more else None


def decisions_per_minute(rows: DataFrame, anchor_ms: int, seconds: int = 60) -> DataFrame:
    """Decisions a minute over the last `seconds`, per decision."""
    new = rows.where(F.col("processed_at").between(F.lit(anchor_ms - seconds * 1000 + 1), F.lit(anchor_ms)))
    return new.groupBy("decision").agg((F.count(F.lit(1)) * 60.0 / seconds).alias("per_minute"))

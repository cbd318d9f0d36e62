"""Totals over trailing periods for every entity and calendar day, idle days included.

Daily totals are joined to the calendar of each entity by range: a day's total counts for the
dates from itself to `longest - 1` days later. Dates are put into coarse buckets as wide as
the longest period, a daily total is offered to the one or two buckets it can reach, and the
join runs on (entity, bucket). After the daily totals, an entity has at most one row a day
whatever its share of all rows, so that no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.payments import counted_payments

DAY_MS = 86_400_000


def trailing_totals(daily: DataFrame, last_day: int, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """daily: (entity, day int, total bigint, n bigint), at most one row per entity and day.

    Result: entity, day, first_day, active (the day has a row), and per period P total_P, n_P and avg_P
    (total_P / P, days without rows counting as 0), for all days from the entity's first to
    last_day. Rows after last_day are left out. Null entities or days have no calendar and are
    left out; a null total counts as 0. Totals that overflow 64 bits raise an error.
    """
    longest = max(periods)
    d = daily.where(F.col("entity").isNotNull() & (F.col("day") <= last_day))
    starts = d.groupBy("entity").agg(F.min("day").alias("_first"))
    dates = starts.select("entity", F.col("_first").alias("first_day"), F.explode(F.sequence("_first", F.lit(last_day))).alias("day"))
    dates = dates.withColumn("_bucket", F.floor(F.col("day") / F.lit(longest)))
    reach = d.select(
        "entity",
        F.col("day").alias("_d"),
        F.coalesce("total", F.lit(0)).alias("_total"),
        F.col("n").alias("_n"),
        F.explode(F.array_distinct(F.array(F.floor(F.col("day") / F.lit(longest)), F.floor((F.col("day") + F.lit(longest - 1)) / F.lit(longest))))).alias("_bucket"),
    )
    c, r = dates.alias("c"), reach.alias("r")
    age = F.col("c.day") - F.col("r._d")
    near = c.join(r, (F.col("c.entity") == F.col("r.entity")) & (F.col("c._bucket") == F.col("r._bucket")) & age.between(0, longest - 1), "left")
    sums: list[Column] = [F.coalesce(F.max(age == 0), F.lit(False)).alias("active")]
    for p in periods:
        for k in ("total", "n"):
            sums.append(F.coalesce(F.sum(F.when(age < p, F.col(f"r._{k}"))), F.lit(0)).alias(f"{k}_{p}"))
    found = near.groupBy("c.entity", "c._bucket", "c.day", "c.first_day").agg(*sums).drop("_bucket")
    return found.withColumns({f"avg_{p}": F.col(f"total_{p}") / F.lit(p) for p in periods})


def customer_days(deliveries: DataFrame, last_day: int, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals per customer of the counted payments in EUR with amounts from 1 to 10^12."""
    until = F.col("event_time") < (last_day + 1) * DAY_MS
    paid = counted_payments(deliveries.where(until & (F.col("currency") == "EUR") & F.col("amount_minor").between(1, 1_000_000_000_000)), "customer_id", "amount_minor", "event_time")
    daily = paid.groupBy(F.col("customer_id").alias("entity"), F.floor(F.col("event_time") / F.lit(DAY_MS)).cast("int").alias("day")).agg(F.sum("amount_minor").alias("total"), F.count(F.lit(1)).alias("n"))
    return trailing_totals(daily, last_day, periods)


def concentrated_idle_days(deliveries: DataFrame, last_day: int) -> DataFrame:
    """(customer_id, day) of idle days from a customer's 30th day on of whose trailing 30-day
    total at least 70 % lies in the last 7 days."""
    t = customer_days(deliveries, last_day)
    wide = lambda c: F.col(c).cast("decimal(30,0)")
    hit = ~F.col("active") & (F.col("day") >= F.col("first_day") + 29) & (F.col("total_30") > 0) & (wide("total_7") * 30 >= wide("total_30") * 21)
    return t.where(hit).select(F.col("entity").alias("customer_id"), F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day"))

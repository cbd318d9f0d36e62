"""Exact percentiles on more rows than a sketch holds apart."""

from math import ceil

from pyspark.sql import functions as F

from ledgerlens.operators import reconcile

PS = (0.0, 0.5, 0.95, 0.99, 0.99999, 1.0)


def rank(n, p):
    return max(1, ceil(p * n))


def test_nearest_rank_is_exact_on_many_sparse_values(spark):
    n = 3_000_000
    df = spark.range(n).select((F.col("id") * F.col("id")).alias("ms"))  # no two values alike, and a sparse tail
    got = {r.p: (r.value, r["count"]) for r in reconcile.nearest_rank(df.repartition(7), "ms", PS).collect()}
    assert got == {p: ((rank(n, p) - 1) ** 2, n) for p in PS}


def test_nearest_rank_with_ties_nulls_and_nothing(spark):
    xs = [5] * 90 + [None] * 7 + [-3, 0, 0, 8, 9, 9, 10, 11, 12, 10**15]
    df = spark.createDataFrame([(x,) for x in xs], "ms long")
    kept = sorted(x for x in xs if x is not None)
    got = {r.p: (r.value, r["count"]) for r in reconcile.nearest_rank(df, "ms", PS).collect()}
    assert got == {p: (kept[rank(100, p) - 1], 100) for p in PS}
    assert reconcile.nearest_rank(df.where("ms IS NULL"), "ms").count() == 0


def test_legs_are_exact_on_many_sparse_values(spark):
    n = 1_500_000
    event = F.col("id").cast("string").alias("event_id")
    sent = spark.range(n).select(event, F.lit(0).cast("bigint").alias("producer_time"))
    done = F.col("id") * F.col("id")
    stored = F.timestamp_millis(done + F.col("id") * 7)
    results = spark.range(n).select(event, done.alias("processed_at"), stored.alias("ingested_at"))
    k = rank(n, 0.95) - 1
    got = {r.leg: (r.value, r["count"]) for r in reconcile.leg_percentiles(sent, results).collect()}
    assert got == {"producer_to_result": (k * k, n), "result_to_storage": (7 * k, n), "producer_to_storage": (k * k + 7 * k, n)}

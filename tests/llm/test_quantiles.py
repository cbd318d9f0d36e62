import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from compare import compare, duck
from ledgerlens import session
from ledgerlens.llm import latency, quantiles, queries


def test_percentiles(spark):
    rng = random.Random(6)
    values = [(rng.choice(["a", "a", "a", "b"]), rng.choice([5, 5, rng.randint(-50, 10**6)]), 1) for _ in range(2000)] + [("one", 3, 1), (None, 3, 1), ("a", None, 1)]
    df = spark.createDataFrame(values, "g string, v long, p int")
    ps = [0.0, 0.01, 0.5, 0.999, 1.0]
    counts = quantiles.value_counts(df, ["g"], "v", bits=None)
    got = {(r.g, r.p): (r.value, r["count"]) for r in quantiles.percentiles(counts, ["g"], ps).collect()}
    for g in ("a", "b", "one"):
        xs = sorted(v for k, v, _ in values if k == g and v is not None)
        for p in ps:
            assert got[g, p] == (xs[max(1, int(np.ceil(p * len(xs)))) - 1], len(xs))
    assert len(got) == 15
    halves = quantiles.merge_counts(quantiles.value_counts(df.where("v < 1000"), ["g"], "v", None), quantiles.value_counts(df.where("v >= 1000"), ["g"], "v", None))
    assert {(r.g, r.p): (r.value, r["count"]) for r in quantiles.percentiles(halves, ["g"], ps).collect()} == got
    assert quantiles.percentiles(counts.limit(0), ["g"], ps).count() == 0


def test_rounding_is_bounded(spark):
    xs = [0, 1, -1, 65_535, 65_536, 65_537, 10**9, -(10**9), 10**18, -(10**18) - 7, (1 << 63) - 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "v long").select(quantiles.rounded(F.col("v"), 16)).collect()]
    for x, y in zip(xs, got):
        assert abs(x - y) <= abs(x) * 2**-15 and (abs(x) >= 65_536 or x == y) and abs(y) <= abs(x)


def test_slow_evaluations(spark, monkeypatch):
    at = dt.datetime(2025, 1, 1)
    rows = [("a", "X", 10, 5, at, 1, 1), ("a", "Y", 99, 5, at, 0, 9), ("b", None, 10, 5, at, 0, 2), ("c", "X", None, 5, at, 0, 3), ("", "X", 10, 5, at, 0, 4), (None, "X", 10, 5, at, 0, 5), ("d", "Y", 2_000, 0, None, 0, 6), ("e", "Y", 100, 0, at, 0, 7)]
    df = spark.createDataFrame(rows, "evaluation_id string, decision string, processed_at long, event_time long, ingested_at timestamp, source_partition int, source_offset long")
    assert [r[0] for r in latency.slow_evaluations(df).collect()] == ["d"]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert [r[0] for r in latency.slow_evaluations(df).collect()] == ["d"]
    assert latency.slow_evaluations(df.limit(0)).count() == 0


def test_against_sql(spark):
    conn = duck("/root/testdata/sf0.001")
    for name, sql in queries.SQL.items():
        ok, said = compare(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], sql, conn)
        assert ok, said

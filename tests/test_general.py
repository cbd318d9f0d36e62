"""The general problems' operators against brute force, and on dirty, empty and skewed inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators import bitemporal, delivery, evaluations, late_periods, sessions, trailing
from ledgerlens.operators.bitemporal import FOREVER, Staircase
from ledgerlens.operators.payments import counted_payments

PAYMENT = "event_id string, customer_id string, device_id string, amount_minor long, currency string, event_time long, producer_time long, source_partition int, source_offset long, total string, n string, _cell int"


def pay(e, c, t, o=0, d="d", a=5, cur="EUR", p=0, made=None):
    return (e, c, d, a, cur, t, t if made is None and t is not None else made, p, o, "clash", "clash", 1)


# --- 1 ---------------------------------------------------------------------------------
@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=8))
def test_rectangles_are_disjoint_and_hold_the_highest_version(quadrants):
    stairs, rects = Staircase(), []
    for v in range(len(quadrants) - 1, -1, -1):
        rects += [(v, *r) for r in stairs.add(*quadrants[v])]
    assert len(rects) <= 2 * len(quadrants)
    for x in range(8):
        for y in range(8):
            want = [v for v, (a, b) in enumerate(quadrants) if a <= x and b <= y]
            got = [v for v, x0, x1, y0, y1 in rects if x0 <= x < x1 and y0 <= y < y1]
            assert got == want[-1:]


def test_versions_as_known(spark):
    rng = random.Random(5)
    rules = [("p" + str(rng.randint(0, 2)), "r" + str(rng.randint(0, 3)), rng.randint(1, 9), rng.randint(0, 50), rng.randint(0, 50)) for _ in range(120)]
    rules += rules[:10] + [(None, "r1", 1, 0, 0), ("p1", None, 1, 0, 0), ("p1", "r1", None, 0, 0), ("p1", "r1", 99, None, 0), ("p1", "r1", 99, 0, None)]
    v = spark.createDataFrame(rules, "policy string, rule string, version long, x long, y long")
    rects = bitemporal.version_rectangles(v, ["policy", "rule"], "version", F.col("x"), F.col("y"))
    events = [(i, "p" + str(rng.randint(0, 3)), rng.randint(-5, 60), rng.randint(-5, 60)) for i in range(300)] + [(1000, None, 9, 9), (1001, "p1", None, 9), (1002, "p1", 9, None)]
    e = spark.createDataFrame(events, "id long, policy string, valid long, known long")
    want = {}
    for i, p, a, b in events:
        for q, r, ver, x, y in rules:
            if None not in (p, a, b, q, r, ver, x, y) and p == q and x <= a and y <= b:
                want[i, r] = max(ver, want.get((i, r), 0))
    got = {(r.id, r.rule): r.version for r in bitemporal.locate(e, rects, ["policy"], "valid", "known").collect()}
    assert got == want
    assert bitemporal.locate(e, rects.limit(0), ["policy"], "valid", "known").count() == 0
    assert bitemporal.locate(e.limit(0), rects, ["policy"], "valid", "known").count() == 0
    assert max(r.valid_to for r in rects.collect()) == FOREVER


# --- 2 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("batch_rows", [3, 10_000])
def test_late_deliveries(spark, batch_rows):
    rng = random.Random(2)
    rows, t = [], {0: 10**9, 1: 10**9}
    for o in range(0, 400, 2):
        for p in (0, 1):
            t[p] += rng.randint(0, 2_000_000)
            when = rng.choice([t[p], t[p], t[p] - 7_200_000, t[p] - rng.randint(0, 20_000_000), None, -1, 0])
            made = when + rng.choice([0, -300_000, -300_001]) if when is not None else None
            rows.append(pay(f"e{rng.randint(0, 250)}", rng.choice(["c", "c", " ", None]), when, o, p=p, made=made, a=rng.choice([None, 0, 7, 10**12, 10**13])))
    df = spark.createDataFrame(rows + [pay("x", "c", 5, None)], PAYMENT)
    best, late, firsts = {}, set(), {}
    for r in sorted(rows, key=lambda r: r[8]):
        ok = r[5] is not None and r[5] > 0 and r[5] <= r[6] + 300_000
        if ok and r[5] <= best.get(r[7], -1) - 7_200_000:
            late.add((r[7], r[8]))
        elif ok and r[1] and r[1].strip():
            firsts.setdefault((r[0], r[5]), r[3] if r[3] and 1 <= r[3] <= 10**12 else 0)
        if ok:
            best[r[7]] = max(best.get(r[7], -1), r[5])
    got = [tuple(r) for r in late_periods.refused_deliveries(df, batch_rows=batch_rows).collect()]
    assert len(late) > 10 and sorted(got) == sorted(late)
    assert late_periods.refused_deliveries(df.limit(0)).count() == 0


def test_partials_of_batches_add_up(spark):
    rows = [pay(f"e{i}", "c", 10**9 + i * 60_000, i, a=i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, PAYMENT)
    whole = late_periods.hourly(df)
    parts = late_periods.partial_aggregates(late_periods.accepted(late_periods.admit(df, *late_periods.FIELDS, batch_rows=50)))
    a, b = parts.where("arrival_batch < 3"), parts.where("arrival_batch >= 3")
    merged = late_periods.combine(late_periods.combine(a), b)
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.collect()} and parts.count() > whole.count()


# --- 4 ---------------------------------------------------------------------------------
def test_trailing_totals(spark):
    rng = random.Random(4)
    daily = {(c, rng.randint(0, 99)): (rng.randint(-9, 99), 1) for c in "ab" for _ in range(30)}
    df = spark.createDataFrame([(c, d, t, n, "x") for (c, d), (t, n) in daily.items()] + [(None, 3, 1, 1, "x"), ("a", None, 1, 1, "x"), ("z", 200, 1, 1, "x")], "entity string, day int, total long, n long, c string")
    got = {(r.entity, r.day): r for r in trailing.trailing_totals(df, 120).collect()}
    first = {c: min(d for k, d in daily if k == c) for c in "ab"}
    assert set(got) == {(c, d) for c in "ab" for d in range(first[c], 121)}
    for (c, d), r in got.items():
        for p in (7, 30):
            want = sum(daily.get((c, x), (0, 0))[0] for x in range(d - p + 1, d + 1))
            assert r[f"total_{p}"] == want and abs(r[f"avg_{p}"] - want / p) < 1e-9
        assert r.active == ((c, d) in daily)
    assert trailing.trailing_totals(df.limit(0), 120).count() == 0


# --- 6 ---------------------------------------------------------------------------------
@settings(deadline=None, max_examples=100)
@given(st.integers(1, 4), st.integers(0, 2**32))
def test_permutation_is_invertible(half, seed):
    words = np.random.default_rng(seed).integers(0, 2**64, (17, 2 * half), np.uint64)
    mixed = delivery.permute(words)
    assert (delivery.restore(mixed) == words).all() and not (mixed == words).all()


def test_table_keeps_least_and_counts():
    rng = np.random.default_rng(1)
    keys = delivery.permute(rng.integers(0, 40, (5000, 2)).astype(np.uint64))
    at = rng.integers(0, 9, (5000, 3))
    t = delivery.QuotientTable(2, 0, 16)
    for i in range(0, 5000, 700):
        t.add(keys[i : i + 700], at[i : i + 700], np.ones(len(keys[i : i + 700]), np.int64))
    want = {}
    for k, a in zip(map(tuple, keys.tolist()), map(tuple, at.tolist())):
        n, least = want.get(k, (0, a))
        want[k] = (n + 1, min(least, a))
    rest, least, copies = t.rows()
    assert {tuple(k): (n, tuple(a)) for k, n, a in zip(rest.tolist(), copies.tolist(), least.tolist())} == want


def test_one_of_each(spark):
    at = dt.datetime(2025, 1, 1)
    hexes = ["eval_" + f"{i:064x}" for i in range(50)]
    ids = hexes + ["eval_" + "A" * 64, "eval_" + "0" * 63, "x", "é" * 40, "y" * 100_000, "eval_", "eval_" + "0" * 64 + "\n"]
    rng = random.Random(3)
    rows = [(rng.choice(ids), rng.choice([at, at + dt.timedelta(seconds=rng.randint(0, 3)), None]), rng.choice([0, 1, None]), rng.choice([rng.randint(0, 5), None]), "c") for _ in range(600)]
    rows += [(hexes[0], at, 1, 1, "c")] * 400 + [(None, at, 0, 0, "c"), ("", at, 0, 0, "c")]
    df = spark.createDataFrame(rows, "evaluation_id string, ingested_at timestamp, source_partition int, source_offset long, copies string")
    key = lambda r: tuple((v is None, v) if v is not None else (True, 0) for v in r[1:4])
    want = {}
    for r in rows:
        if r[0]:
            n, b = want.get(r[0], (0, r))
            want[r[0]] = (n + 1, min(b, r, key=key))
    got = delivery.one_of_each(df.repartition(5)).collect()
    assert len(got) == len(want)
    for r in got:
        n, b = want[r.evaluation_id]
        assert (r.copies, r.source_partition, r.source_offset) == (n, b[2], b[3])
    assert delivery.one_of_each(df.limit(0)).count() == 0


def test_kept_copies_and_latencies(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [("a", "X", 10, 5, at, 1, 1), ("a", "Y", 99, 5, at, 0, 9), ("b", None, 10, 5, at, 0, 2), ("c", "X", None, 5, at, 0, 3), ("", "X", 10, 5, at, 0, 4), (None, "X", 10, 5, at, 0, 5), ("d", "Y", 2_000, 0, None, 0, 6), ("e", "Y", 100, 0, at, 0, 7)]
    df = spark.createDataFrame(rows, "evaluation_id string, decision string, processed_at long, event_time long, ingested_at timestamp, source_partition int, source_offset long")
    got = {tuple(r) for r in evaluations.latencies(df).collect()}
    assert got == {("a", "Y", 94), ("d", "Y", 2_000), ("e", "Y", 100)}


# --- 7 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("cell_ms", [250, 1000, 10**9])
def test_sessions(spark, cell_ms):
    rng = random.Random(7)
    events = [(rng.choice("aab"), rng.choice(["x", "x", None]), rng.randint(-3000, 9000), "c") for _ in range(300)] + [(None, "x", 1, "c"), ("a", "x", None, "c"), ("edge", "x", 0, "c"), ("edge", "x", 100, "c"), ("edge", "x", 201, "c")]
    df = spark.createDataFrame(events, "k string, d string, t long, n string")
    want, by = [], {}
    for k, d, t, _ in events:
        if None not in (k, d, t):
            by.setdefault((k, d), []).append(t)
    for (k, d), ts in by.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:] + [10**18]:
            if t - run[-1] > 100:
                want.append((k, d, run[0], run[-1], run[-1] - run[0], len(run)))
                run = [t]
            else:
                run.append(t)
    got = [tuple(r) for r in sessions.sessions(df, ["k", "d"], "t", gap_ms=100, cell_ms=cell_ms).collect()]
    assert sorted(got) == sorted(want)
    assert ("edge", "x", 0, 100, 100, 2) in got and sessions.sessions(df.limit(0), ["k", "d"], "t").count() == 0


def test_late_batches_merge_into_stored_sessions(spark):
    rows = [("a", t) for t in (0, 90, 300, 380, 1000)]
    df = spark.createDataFrame(rows, "k string, t long")
    late = spark.createDataFrame([("a", 195), ("a", 700)], "k string, t long")
    i = sessions.Intervals(["k"], 110, 400)
    state = i.merged(i.opened(df, "t"))
    two = i.read(i.merged(state, i.merged(i.opened(late, "t"))), watermark=600)
    one = sessions.sessions(df.unionByName(late), ["k"], "t", 110, 400)
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r)[:-1] for r in two.collect()) == [("a", 0, 380, 380, 5), ("a", 700, 700, 0, 1), ("a", 1000, 1000, 0, 1)]
    assert [r.final for r in two.orderBy("started_at").collect()] == [True, False, False]


def test_device_sessions_take_late_payments_in(spark):
    hour = 3_600_000
    rows = [pay("a", "c", 10 * hour, 1), pay("b", "c", 10 * hour + 2_000_000, 2), pay("d", "c", 20 * hour, 3), pay("late", "c", 10 * hour + 1_000_000, 4), pay("late", "c", 10 * hour + 1_000_000, 5)]
    df = spark.createDataFrame(rows, PAYMENT)
    assert late_periods.refused_deliveries(df).count() == 2
    got = sorted((r.started_at, r.ended_at, r.n) for r in sessions.device_sessions(df).collect())
    assert got == [(10 * hour, 10 * hour + 2_000_000, 3), (20 * hour, 20 * hour, 1)]


def test_counted_payments(spark):
    rows = [pay("a", "c", 10), pay("a", "c", 10, 1), pay("b", " ", 10), pay("d", None, 10), pay("e", "c", 0), pay("f", "c", 10, made=-400_000), pay("f", "c", 10, 3), pay("g", "c", None), pay(None, "c", 10), pay("h", "c", 300_010, made=10), pay("i", "c", 300_011, made=10)]
    got = counted_payments(spark.createDataFrame(rows, PAYMENT), "customer_id")
    assert sorted(r[0] for r in got.collect()) == ["a", "f", "h"]


def test_extreme_times_and_amounts_do_not_overflow(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [pay("a", "c", top, 1, made=top), pay("b", "c", low, 2, made=low), pay("d", "c", 10, 3, made=top), pay("e", "c", 5_000_000, 4, a=10**12), pay("f", "c", top, 5, made=low)]
    df = spark.createDataFrame(rows, PAYMENT)
    assert sorted(r[0] for r in counted_payments(df, "customer_id").collect()) == ["a", "d", "e"]
    assert {r.day for r in trailing.customer_days(df, 3).collect()} == {0, 1, 2, 3}
    assert late_periods.refused_deliveries(df).count() == 2
    assert sorted(r.started_at for r in sessions.device_sessions(df).collect()) == [10, 5_000_000, top]


# --- beyond the size that is broadcast -------------------------------------------------------
def test_large_sides_are_joined_by_exchange(spark, monkeypatch):
    from ledgerlens import session
    from ledgerlens.operators import nested
    from ledgerlens.sources.tables import table

    e, r, p = (table(spark, "/root/testdata/sf0.001", n) for n in ("evaluations", "risk_rules", "payments"))
    results = lambda: [sorted(map(tuple, df.collect())) for df in (bitemporal.other_version_than_implied(e, r), nested.Flat(e).contributors(), late_periods.refused_deliveries(p))]
    small = results()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert results() == small and all(small)


def test_hot_keys_are_split(spark):
    """A third of all rows under one key: no task of the interval, frontier or look-back stages gets them all."""
    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("k"), (F.col("id") * 250_000).alias("t"))
    s = sessions.sessions(rows, ["k"], "t")
    assert s.agg(F.sum("n")).first()[0] == n
    cells = rows.where("k = 'hot'").select(F.floor(F.col("t") / sessions.CELL_MS)).distinct().count()
    assert cells > 80
    copies = spark.range(n).select(F.when(F.col("id") % 3 == 0, "eval_" + "0" * 64).otherwise(F.concat(F.lit("eval_"), F.sha2(F.col("id").cast("string"), 256))).alias("evaluation_id"), F.timestamp_seconds(F.col("id")).alias("ingested_at"), F.lit(0).alias("source_partition"), F.col("id").alias("source_offset"))
    got = delivery.one_of_each(copies.repartition(4))
    assert got.count() == n - n // 3 + 1 and got.where("copies > 1").select("copies", "source_offset").collect() == [(n // 3, 0)]

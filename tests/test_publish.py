import datetime as dt

import pytest

from ledgerlens.operators import overview, reconcile, store
from ledgerlens.plans.publish import Reader, Unavailable, publish, retain
from ledgerlens.sources.tables import table

NOW = 1_748_563_200_000


@pytest.fixture(scope="module")
def clean(spark):
    """Deliveries of transactions without conflict, identified."""
    e = table(spark, "/root/testdata/sf0.001", "evaluations").where("evaluation_id <> '' AND ingested_at <= timestamp_ntz '2025-05-29 23:59:59'")
    return e.join(store.integrity_conflicts(e).select("transaction_id"), "transaction_id", "left_anti").select(e.columns).cache()


def test_publish_and_read(spark, clean, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Unavailable):
        Reader(spark, root).publication(NOW)
    p = publish(clean, root, NOW, generation="g1")
    assert p.status == "READY" and p.deliveries == clean.count() and p.assessments == clean.select("evaluation_id").distinct().count()
    reader = Reader(spark, root)
    want = sorted(r[0] for r in clean.select("customer_id").distinct().collect() if r[0])
    got, cursor = [], ""
    while True:
        items, cursor = reader.customers(NOW + 1000, cursor=cursor or "")
        got += [i["customer_id"] for i in items]
        if not cursor:
            break
    assert got == want
    top = max(want, key=lambda c: clean.where(clean.customer_id == c).count())
    seen, cursor = [], ""
    while True:
        items, cursor = reader.timeline(NOW, top, cursor or "")
        seen += [(i["event_time"], i["evaluation_id"]) for i in items]
        if not cursor:
            break
    assert seen == sorted(seen, reverse=True) and len(seen) == clean.where(clean.customer_id == top).select("evaluation_id").distinct().count() > overview.PAGE
    assert reader.overview(NOW, "24h")["totals"].first().transactions == clean.where(f"processed_at >= {NOW - 86_400_000}").select("evaluation_id").distinct().count()
    with pytest.raises(overview.CursorError):
        reader.customers(NOW, cursor="abc")
    with pytest.raises(overview.CursorError):
        reader.customers(NOW, "x", cursor=overview.encode_cursor("customers", generation="g1", customer_id="a", q="|ALL"))
    with pytest.raises(Unavailable):
        reader.publication(NOW + 120_001)
    # a later generation serves, cursors stay with theirs, and old content goes
    publish(clean, root, NOW + 60_000, generation="g2")
    assert reader.publication(NOW + 61_000) == "g2" and reader.publication(NOW + 61_000, "g1") == "g1"
    assert retain(spark, root, NOW + 600_001) == ["g1"]
    # a conflict blocks everything
    bad = clean.unionByName(clean.limit(1).withColumn("risk_score", clean.risk_score + 1))
    assert publish(bad, root, NOW + 90_000, generation="g3").status == "BLOCKED"
    with pytest.raises(Unavailable):
        reader.publication(NOW + 91_000, "g2")
    # content goes however old it is when this runs, markers after a day, the newest stays
    assert retain(spark, root, NOW + 3 * 86_400_000) == ["g2"] and retain(spark, root, NOW + 3 * 86_400_000) == []
    assert [r.generation for r in spark.read.parquet(f"{root}/publications").collect()] == ["g3"]


def test_conflicts_hide_rows(spark):
    names = [*store.CONTENT, "processed_at", "source_topic", "source_partition", "source_offset", "evaluation_id", "ingested_at"]
    kinds = {"amount_minor": "long", "risk_score": "int", "matched_rules": "array<string>", "reason_codes": "array<string>", "event_time": "long", "policy_version": "long", "processed_at": "long", "source_partition": "int", "source_offset": "long", "ingested_at": "timestamp"}

    def row(**c):
        base = dict.fromkeys(names, "x") | {k: 1 for k, t in kinds.items() if t in ("long", "int")} | {"matched_rules": ["R001"], "reason_codes": [], "amount_minor": 100, "ingested_at": dt.datetime(2025, 1, 1), "evaluation_id": "e1", "transaction_id": "t1", "decision": "APPROVE"} | c
        return tuple(base[n] for n in names)

    make = lambda *rows: spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    retries = (row(), row(), row(source_partition=2, source_offset=9, processed_at=7))
    df = make(*retries)
    one = store.evaluations_logical(df, "amount_minor", "processed_at").collect()
    assert [(r.delivery_count, r.content_variants, r.amount_minor, r.processed_at) for r in one] == [(3, 1, 100, 1)]
    assert store.decisions_current(df).count() == store.decisions_summary(df).count() == 1 and store.integrity_conflicts(df).count() == 0
    for conflict in (row(risk_score=80, decision="REJECT"), row(policy_snapshot="y"), row(rule_evidence="y"), row(matched_rules=[])):
        bad = make(*retries, conflict)
        assert store.evaluation_conflicts(bad).count() == 1 and store.decisions_current(bad).count() == 0
    two = make(*retries, row(evaluation_id="e2"))
    assert [(r.evaluations, r.content_variants) for r in store.integrity_conflicts(two).collect()] == [(2, 1)]
    spans = make(row(), row(transaction_id="t3"))
    assert store.integrity_conflicts(spans).count() == 2 and store.decisions_summary(spans).count() == 0


def test_reconciliation(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    s = reconcile.outcomes(ids("a", "b", "c", "d", "e", None, "a"), ids("a", "e"), ids("b", "e"), ids("c"))
    assert {r.event_id: r.state for r in s.collect()} == {"a": "EVALUATED", "b": "INVALID", "c": "LATE", "d": "UNRESOLVED", "e": "CONTRADICTED"}
    assert [r.event_id for r in reconcile.unexpected(ids("a", "z", None), ids("a")).collect()] == ["z"]
    pos = lambda *o: reconcile.position_digest(spark.createDataFrame([("t", 0, x) for x in o], "source_topic string, source_partition int, source_offset long"), block=2).first()
    assert pos(1, 2, 5).digest == pos(5, 1, 2).digest != pos(1, 2, 6).digest and (pos(1, 1, 2).repeated, pos(1, 1, 2).state, pos(1, 1, 2).digest) == (1, "REPEATED", None)
    gaps = reconcile.offset_gaps(spark.createDataFrame([("t", 0, x) for x in (0, 1, 4, 65_535, 65_536, 200_000)], "source_topic string, source_partition int, source_offset long"))
    assert sorted((r.after, r.before) for r in gaps.collect()) == [(1, 4), (4, 65_535), (65_536, 200_000)]
    empty = spark.createDataFrame([], "amount_minor long, decision string, processed_at long, event_time long")
    assert tuple(overview.totals(empty).first()) == (0, 0, 0, 0, 0, 0)


def test_counters_and_alerts(spark):
    from ledgerlens.operators import metrics

    df = spark.createDataFrame([("DECISION", "APPROVE", 5), ("DECISION", "REJECT", 7), ("LATE", None, 9)], "kind string, decision string, amount_minor long")
    seen, o = metrics.observed(df, "job")
    assert seen.count() == 3
    want = {"rows": 3, "late": 1, "approve": 1, "review": 0, "reject": 1, "amount_minor": 12}
    assert {k: o.get[k] for k in want} == want and sum(o.get.values()) == 18
    assert metrics.alerts(o.get, {"late": 0, "rows": 3, "lag": 1}) == ["lag", "late"]


def test_alerts_need_their_windows_and_the_watchdog_its_time(spark):
    from ledgerlens.operators import metrics

    rows = [(t * 300_000 + i, True) for t, n in ((0, 400), (1, 400), (2, 100), (3, 400), (5, 400)) for i in range(n)]
    log = spark.createDataFrame(rows, "at long, invalid boolean")
    got = {r.time // 300_000: r.raised for r in metrics.raised(log, "at", "invalid", metrics.ALERTS[0]).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 5: False}
    w = metrics.Watchdog(1_000)
    assert [w.look("q", m, at, n) for m, at, n in (("a", 0, 5), ("a", 900, 5), ("a", 1_100, 0), ("a", 1_200, 5), ("b", 1_300, 5), ("b", 2_400, 5))] == [False, False, False, True, False, True] and w.overdue == 2

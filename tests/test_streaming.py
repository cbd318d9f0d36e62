"""Streams against the batch operators."""

import json
import time
from dataclasses import asdict, replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import late_periods, lookback, sessions, validate
from ledgerlens.operators.payments import counted_payments
from ledgerlens.operators.score import score
from ledgerlens.plans.reference import POLICY
from ledgerlens.sources import avro, generator, schemas, streams
from ledgerlens.streaming import periods, pipeline, scoring

NAMES = [f.name for f in schemas.TRANSACTION.fields]


def tx(i, t, amount=10, device="d0", customer="C1"):
    return (f"{i}", f"txn-{i}", customer, "M1", amount, "EUR", "IT", device, "APPROVED", t, t)


def drain(spark, df, name, rows):
    """Runs a stream until `rows` input rows and one batch more are through: in processing time it never idles."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for _ in range(240):
            seen = [p["numInputRows"] for p in q.recentProgress]
            if q.exception() or sum(seen) >= rows and seen[-1] == 0:
                break
            time.sleep(0.25)
    finally:
        q.stop()
    return spark.table(name).collect()


def feed(spark, path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schemas.TRANSACTION).coalesce(1).write.mode("append").parquet(path)


def test_scores_like_the_batch_and_routes_late(spark, tmp_path):
    t0 = 1_700_000_000_000
    first = [tx(i, t0 + i * 3_000, 70_000, f"d{i % 4}") for i in range(12)] + [tx("tie-b", t0 + 3_000), tx("tie-a", t0 + 3_000)]
    late = [tx("late", t0), tx("end", t0 + 500_000)]
    path = str(tmp_path / "in")
    feed(spark, path, first)
    src = streams.file_stream(spark, path, schemas.TRANSACTION, max_files=1)
    checkpoint = str(tmp_path / "cp")
    out = scoring.score_stream(src, POLICY)
    run = lambda: periods.route(out, str(tmp_path / "out"), checkpoint).trigger(availableNow=True).start().awaitTermination(240)
    run()
    feed(spark, path, late)
    run()
    feed(spark, path, [tx("beyond", t0 + 900_000)])
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.event_id for r in rows if r.kind == "LATE"] == ["late"]
    got = {r.event_id: r for r in rows if r.kind == "DECISION"}
    assert set(got) >= {r[0] for r in first} and "beyond" not in got and len(got) == len([r for r in rows if r.kind == "DECISION"])
    batch = spark.createDataFrame(first + [r for r in late if r[0] in got], schemas.TRANSACTION)
    for r in lookback.observations(batch, POLICY.rules).collect():
        assert list(got[r.event_id].observed) == [r[f"o_{x.rule_id}"] for x in POLICY.rules], r.event_id


def test_stream_makes_whole_decisions_by_the_policy_at_admission(spark, tmp_path):
    t0 = 1_700_000_000_000
    first = [tx(i, t0 + i * 3_000, 70_000, f"d{i % 4}") for i in range(9)]
    then = [tx("new", t0 + 100_000, 70_000)]
    path, later = str(tmp_path / "in"), replace(POLICY, version=2, rules=(replace(POLICY.rules[0], threshold=0, version=2), *POLICY.rules[1:]))
    for policy, rows in ((POLICY, first), (later, then), (later, [tx("end", t0 + 900_000)])):
        feed(spark, path, rows)
        out = scoring.score_stream(streams.file_stream(spark, path, schemas.TRANSACTION), policy)
        periods.route(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'DECISION'").collect()}
    batch = spark.createDataFrame(first + then, schemas.TRANSACTION)
    names = [f.name for f in schemas.DECISION.fields if f.name != "processed_at"]
    for policy, rows in ((POLICY, first), (later, then)):
        want = {r.event_id: r for r in score(batch, policy, F.lit(0)).collect()}
        for r in rows:
            assert {n: got[r[0]][n] for n in names} == {n: want[r[0]][n] for n in names}
    assert got["8"].policy_version == 1 and got["new"].policy_version == 2 and got["8"].processed_at > t0


def test_once(spark, tmp_path):
    path = str(tmp_path / "in")
    other = list(tx("a", 1))
    other[2] = "C2"
    feed(spark, path, [tx("a", 1), tx("a", 1), tx("b", 2), tuple(other)])
    got = drain(spark, scoring.once_stream(streams.file_stream(spark, path, schemas.TRANSACTION)), "once", 4)
    kinds = sorted((r.event_id, r.kind) for r in got)
    assert kinds in ([("a", "CONFLICT"), ("a", "FIRST"), ("b", "FIRST")], [("a", "CONFLICT"), ("a", "CONFLICT"), ("a", "FIRST"), ("b", "FIRST")])


def test_session_stream_has_the_same_gap(spark, tmp_path):
    path, gap = str(tmp_path / "in"), 1_800_000
    times = [10**12, 10**12 + gap, 10**12 + 2 * gap + 1, 10**12 + 9 * gap]
    feed(spark, path, [tx(i, t) for i, t in enumerate(times)], [tx("x", 10**12 + 100 * gap)])
    src = streams.file_stream(spark, path, schemas.TRANSACTION)
    got = {(r.started_at, r.ended_at, r.n) for r in drain(spark, periods.session_stream(src, ["customer_id"]), "sess", 5)}
    want = {(r.started_at, r.ended_at, r.n) for r in sessions.sessions(spark.read.parquet(path), ["customer_id"]).collect()}
    assert got == {w for w in want if w[0] < 10**12 + 50 * gap}


def test_period_table_adds_up_batch_by_batch(spark, tmp_path):
    p = spark.read.parquet("/root/testdata/sf0.001/payments.parquet")
    t = periods.PeriodTable(str(tmp_path))
    cuts = [0, 120, 121, 300, 10**9]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + (i == 2)):  # a batch that runs again replaces itself
            t.add(p.where(f"source_offset >= {lo} AND source_offset < {hi}"), i)
    want = {tuple(r) for r in late_periods.hourly(p).collect()}
    assert {tuple(r) for r in t.read(spark).collect()} == want and len(want) > 100
    # the planted late deliveries are refused batch by batch as over the whole
    refused = {tuple(r) for r in late_periods.refused_deliveries(p).collect()}
    assert {tuple(r) for r in t.refused(spark).collect()} == refused and len(refused) > 20


def test_session_table_takes_late_rows_batch_by_batch(spark, tmp_path):
    p = spark.read.parquet("/root/testdata/sf0.001/payments.parquet")
    paid = counted_payments(p, "customer_id", "device_id", "event_time").where("device_id IS NOT NULL")
    first = p.groupBy("event_id").agg(F.min("source_offset").alias("o"))
    arrived = paid.join(first, "event_id")
    t = periods.SessionTable(str(tmp_path / "s"), ["customer_id", "device_id"])
    cuts = [0, 150, 151, 280, 10**9]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + (i == 2)):
            t.add(arrived.where(f"o >= {lo} AND o < {hi}"), i)
    want = sorted(tuple(r) for r in sessions.device_sessions(p).collect())
    assert sorted(tuple(r)[:-1] for r in t.read(spark).collect()) == want and len(want) > 300


def test_generator(spark):
    c = generator.GeneratorConfig(customers=50, per_customer=20, hot_percent=30)
    a, b = generator.payments(spark, c).collect(), generator.payments(spark, c).repartition(5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({(r.source_partition, r.source_offset) for r in a}) == len(a) > 1000
    assert len({r.event_id for r in a}) == 1000 and sorted(map(tuple, generator.payments(spark, replace(c, seed=8)).collect())) != sorted(map(tuple, a))
    assert 0.25 < sum(r.customer_id == "cust-0" for r in a) / len(a) < 0.4
    for bad in (dict(weights=(1, 2, 3, 4)), dict(customers=0), dict(retry_percent=51)):
        with pytest.raises(ValueError):
            replace(c, **bad)


def test_stories(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name":"a","label":"SUSPICIOUS","payments":[{"seconds":-60,"amount_minor":5,"device":"d","merchant":"m","status":"APPROVED"},{"seconds":0,"amount_minor":6,"device":"d","merchant":"m","status":"DECLINED"}]}]')
    got = generator.stories(spark, str(tmp_path / "s.json"), 10**12).orderBy("event_time").collect()
    assert [(r.event_id, r.event_time, r.target) for r in got] == [("evt-a-0", 10**12 - 60_000, False), ("evt-a-1", 10**12, True)]


def test_frames_json_and_replay(spark, tmp_path):
    body = b'{"event_id":"e","amount_minor":5}'
    rows = [("t", 0, i, bytearray(p) if p is not None else None) for i, p in enumerate([b"\x00\x00\x00\x00\x07" + body, b"\x01" + body, None, b"\x00\xff\xff\xff\xff", b"\x00\x00\x00\x00\x07[]x"])]
    df = spark.createDataFrame(rows, "source_topic string, source_partition int, source_offset long, payload binary")
    got = streams.json_records(df.select("*", *streams.framed()), schemas.TRANSACTION).orderBy("source_offset").collect()
    assert [r.schema_id for r in got] == [7, -1, -1, -1, 7]
    assert got[0].event_id == "e" and got[0].amount_minor == 5 and got[0].decode_error is None
    assert [r.decode_error is None for r in got] == [True, False, False, False, False]
    target = str(tmp_path / "r")
    ranges = {("t", 0): (1, 4)}
    assert streams.replay(df, ranges, target) == {"records": 3, "written": 0}
    audit = str(tmp_path / "audit")
    assert streams.replay(df, ranges, str(tmp_path / "none"), audit=audit)["written"] == 0
    seen = spark.read.parquet(audit).first()
    assert (seen.records, seen.first, seen.last, seen.state, seen.executed, len(seen.digest)) == (3, 1, 3, "WHOLE", False, 64)
    assert streams.replay(df, ranges, target, execute=True, files=2)["written"] == 3 == spark.read.parquet(target).count()
    with pytest.raises(ValueError):
        streams.replay(df, ranges, target, True, most=2)
    assert df.agg(streams.first_offsets_are_zero(df)).first()[0]


def run_out(q, rows):
    """Waits until a stream has read so many new rows and one batch more is through: in processing time it never ends by itself."""
    for _ in range(480):
        seen = [p["numInputRows"] for p in q.recentProgress]
        if not q.isActive or sum(seen) >= rows and seen[-1] == 0:
            break
        time.sleep(0.25)
    q.stop()
    assert q.exception() is None, q.exception()


def wired(spark, rows, topic, encode, offset=0):
    """Wire records of payloads, as a broker keeps them."""
    df = spark.createDataFrame([(topic, i % 3, offset + i, 1_700_000_500_000, b"k", encode(r) if not isinstance(r, bytes | None) else r, []) for i, r in enumerate(rows)], pipeline.WIRE)
    return df.coalesce(1)


@pytest.mark.parametrize("binary", [False, True])
def test_pipeline_from_wire_records_to_the_store(spark, tmp_path, binary):
    t0, names = 1_700_000_000_000, [f.name for f in schemas.TRANSACTION.fields]
    schema, rule_schema = avro.record("Transaction", schemas.TRANSACTION), avro.record("RiskRule", schemas.RULE)

    def encode(r):
        value = dict(zip(names, r)) if isinstance(r, tuple) else asdict(r)
        if binary:
            return b"\x00\x00\x00\x00" + bytes([7 if isinstance(r, tuple) else 8]) + avro.write(schema if isinstance(r, tuple) else rule_schema, value)
        return b"\x00\x00\x00\x00\x07" + json.dumps(value).encode()

    valid = [tx(i, t0 + i * 3_000, 70_000, f"d{i % 4}") for i in range(9)]
    other = list(valid[0])
    other[4] = 71_000
    another = list(tx("other", t0 + 28_000))
    another[1] = "txn-3"  # a known transaction under another event
    broken = [b"\x01abc", None, b"\x00\x00\x00\x00\x63x" if binary else b"\x00\x00\x00\x00\x07[]", b"\x00" + b"x" * (validate.MAX_PAYLOAD + 1), tx("bad", t0, 0), tx("future", t0 + 10**9)]
    p = pipeline.Pipeline(spark, str(tmp_path), POLICY, writers={7: schema} if binary else None, rule_writers={8: json.dumps(rule_schema)} if binary else None)
    raw, control = str(tmp_path / "raw"), str(tmp_path / "control")
    put = lambda df, path: df.write.mode("append").parquet(path)
    stream = lambda path: streams.file_stream(spark, path, pipeline.WIRE)

    def run(rows):
        run_out(p.admit(stream(raw)), rows)
        p.score().awaitTermination(240)

    put(wired(spark, [*valid, valid[2], tuple(other), tuple(another), *broken], "payments.raw", encode), raw)
    run(18)
    strict = replace(POLICY.rules[0], version=2, threshold=0, score=70)
    put(wired(spark, [strict, replace(strict, version=1, threshold=9), replace(strict, version=9, currency="USD")], "risk.rules", encode), control)
    p.rules(stream(control)).awaitTermination(240)
    put(wired(spark, [tx("new", t0 + 40_000, 5)], "payments.raw", encode, 100), raw)
    run(1)
    put(wired(spark, [tx("end", t0 + 200_000, 5)], "payments.raw", encode, 200), raw)
    run(1)
    put(wired(spark, [tx("late", t0 + 1_000, 5), tx("end2", t0 + 201_000, 5)], "payments.raw", encode, 300), raw)
    run(2)
    p.archive(stream(raw)).awaitTermination(240)
    for name in ("decisions", "dlq", "late"):
        p.materialise(name).awaitTermination(240)
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    assert read("admitted").count() == 9 + 4 and sorted(r.event_id for r in read("conflicts").collect()) == ["0", "other"]
    codes = sorted(r.error_code for r in read("dlq").collect())
    want = ["DESERIALIZATION_ERROR", "DESERIALIZATION_ERROR", "SCHEMA_ERROR" if binary else "DESERIALIZATION_ERROR", "INVALID_AMOUNT", "INVALID_EVENT_TIME", "PAYLOAD_TOO_LARGE"]
    assert codes == sorted(want) and [r.error_code for r in read("dlq-rules").collect()] == ["INVALID_RULE_CONFIGURATION"]
    got = {r.event_id: r for r in read("store/evaluations").collect()}
    assert set(got) == {*(r[0] for r in valid), "new"}
    assert got["8"].policy_id == "default" and got["new"].policy_id == "dynamic" and "R001" in got["new"].matched_rules and "R001" not in got["3"].matched_rules
    batch = {r.event_id: r.risk_score for r in score(spark.createDataFrame(valid, schemas.TRANSACTION), POLICY, F.lit(0)).collect()}
    assert {e: got[e].risk_score for e in batch} == batch
    outcomes = read("store/processing_outcomes").groupBy("outcome").count().collect()
    assert {r[0]: r[1] for r in outcomes} == {"INVALID": 6, "LATE": 1}
    assert read("store/payment_ingress").count() == 9 + 3 + 6 + 4 and read("store/payment_ingress").where("value_is_null").count() == 1
    assert read("store/materializer_rejections").count() == 0

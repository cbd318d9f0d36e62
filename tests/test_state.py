"""The stateful scorer on a plain state: running totals against full scans, policies, frontiers, limits. And the record codec."""

import random
import struct
from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from ledgerlens.plans.reference import POLICY
from ledgerlens.sources import avro, schemas
from ledgerlens.streaming import scoring
from ledgerlens.streaming.scoring import Customer, evidence, policy_text


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))

    def keys(self):
        return list(super().keys())


class Job:
    """Calls the processor of one customer as Spark does: rows first, then the timers that are due, in order."""

    def __init__(self, policy=POLICY):
        self.maps, self.values, self.timers, self.watermark = {}, {}, set(), -1
        self.processor = Customer(policy)
        self.processor.init(self)

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.values.setdefault(name, Value())

    def registerTimer(self, t):
        self.timers.add(t)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.now

    def feed(self, *rows, policy=None):
        text = policy_text(policy) if policy else None
        return list(self.processor.handleInputRows(("C1",), iter([Row(**r, policy=text) for r in rows]), self))

    def advance(self, watermark):
        self.watermark, out = watermark, []
        while due := [t for t in self.timers if t <= watermark]:
            self.now = min(due)
            self.timers.discard(self.now)
            out += self.processor.handleExpiredTimer(("C1",), self, self)
        return out

    def empty(self):
        return not any(self.maps.values()) and not any(v.exists() for v in self.values.values()) and not self.timers


def pay(i, t, amount=10, device="d0", status="APPROVED", currency="EUR"):
    return dict(event_id=f"{i}", transaction_id=f"txn-{i}", customer_id="C1", merchant_id="M1", amount_minor=amount, currency=currency, country="IT", device_id=device, status=status, event_time=t, producer_time=t)


def rules(**changes):
    """A policy with other values in its first rule."""
    return replace(POLICY, version=POLICY.version + 1, rules=(replace(POLICY.rules[0], **changes), *POLICY.rules[1:]))


def test_running_totals_equal_full_scans():
    rng, t, job, all_rows, policies = random.Random(42), 1_000_000, Job(), [], {}
    current = POLICY
    for i in range(600):
        if i % 75 == 74:  # a rule of another kind, window or threshold
            kind = rng.choice(["TX_COUNT_VELOCITY", "UNIQUE_DEVICES", "AMOUNT_VELOCITY", "DECLINE_THEN_APPROVAL"])
            current = replace(POLICY, version=i, rules=(replace(POLICY.rules[0], type=kind, window_seconds=rng.choice([60, 120, 600, 3_600]), threshold=rng.randint(0, 9)), *POLICY.rules[1:]))
        t += 120_000 if i % 151 == 150 else rng.choice([0, 0, 1, 999, 1_000, 20_000, 60_000])
        r = pay(f"{i:03}", t, rng.randint(1, 90_000), f"d{rng.randint(0, 5)}", rng.choice(["APPROVED", "DECLINED"]))
        policies[r["event_id"]] = current
        all_rows.append(r)
        job.feed(r, policy=current)
        if rng.random() < 0.3:
            job.got = getattr(job, "got", []) + job.advance(t - 1)
    got = {r.event_id: r for r in job.got + job.advance(t + 1)}
    order = sorted(all_rows, key=lambda r: (r["event_time"], r["event_id"]))
    for i, r in enumerate(order):
        past = order[:i]
        seen = max((h["event_time"] for h in past if h["device_id"] == r["device_id"]), default=None)
        assert list(got[r["event_id"]].rule_evidence) == evidence(policies[r["event_id"]], r, past, seen), r
    assert len(got) == 600 and len(job.maps["log"]) < 600 and len(job.maps["totals"]) <= scoring.MAX_TOTALS
    job.advance(t + 40 * 86_400_000)
    assert job.empty()


def test_order_lateness_and_expiry():
    job = Job()
    assert job.feed(pay("b", 100_100), pay("a", 100_000)) == []
    assert [r.event_id for r in job.advance(100_100)] == ["a", "b"]
    late = job.feed(pay("c", 100_000), pay("d", 4_100_000))
    assert [(r.event_id, r.kind, r.lateness_ms) for r in late] == [("c", "LATE", 100)]
    assert [r.risk_score for r in job.advance(4_100_000)] == [0]


def test_payments_wait_for_the_watermark_and_the_frontier_outlives_a_restart():
    job = Job(rules(threshold=0))
    job.feed(pay("a", 100_010))
    assert job.advance(100_000) == [] and [r.risk_score for r in job.advance(100_010)] == [25]
    job.watermark = -1  # a watermark begins anew; the customer's frontier does not
    assert [r.kind for r in job.feed(pay("b", 100_009), pay("c", 100_010), pay("d", 100_011))] == ["LATE", "LATE"]
    assert [r.event_id for r in job.advance(100_011)] == ["d"]


def test_policy_is_that_of_the_admission():
    job, v2, v3 = Job(), rules(threshold=0, score=70, version=2), rules(enabled=False, version=3)
    job.feed(pay("a", 100_000), policy=v2)
    job.feed(pay("b", 100_001), policy=v3)
    assert [(r.event_id, r.decision, r.risk_score) for r in job.advance(100_001)] == [("a", "REJECT", 70), ("b", "APPROVE", 0)]
    job.feed(pay("c", 9_000_000, 90_000, "x"), policy=POLICY)
    job.feed(pay("d", 19_000_000, 90_000, "y"), policy=replace(POLICY, version=2, review=70, reject=90))
    assert [(r.decision, r.risk_score, r.policy_version) for r in job.advance(19_000_000)] == [("REVIEW", 30, 1), ("APPROVE", 30, 2)]


def test_limits_fail_the_job(monkeypatch):
    for name, most in (("MAX_PENDING", 3), ("MAX_HISTORY", 3), ("MAX_DEVICES", 2)):
        monkeypatch.setattr(scoring, name, most)
        job = Job()
        with pytest.raises(RuntimeError):
            job.feed(*[pay(i, 1_000 + i, device=f"d{i}") for i in range(4)])
            job.advance(10_000)
        monkeypatch.undo()


def test_hot_customer_is_linear():
    job = Job()
    touched = []
    log = job.maps["log"]
    get = log.getValue
    log.getValue = lambda k: touched.append(k) or get(k)
    for i in range(3_000):
        job.feed(pay(f"{i:05}", 1_000_000 + i * 500, device=f"d{i % 7}"))
    assert len(job.advance(10_000_000)) == 3_000
    assert len(touched) < 3_000 * 12  # a few looks at the fronts of windows per payment, never at a whole window


def test_records_go_round(tmp_path):
    for fields in (schemas.TRANSACTION, schemas.RULE, schemas.DECISION):
        s = avro.record("R", fields)
        rng = random.Random(1)
        make = {T.StringType(): lambda: rng.choice(["", "é€", "x" * 300]), T.LongType(): lambda: rng.choice([0, -1, 63, 64, (1 << 63) - 1, -(1 << 63)]), T.IntegerType(): lambda: rng.randint(-(1 << 31), (1 << 31) - 1), T.BooleanType(): lambda: rng.random() < 0.5}

        def value(t):
            if isinstance(t, T.ArrayType):
                return [value(t.elementType) for _ in range(rng.randint(0, 3))]
            return {f.name: value(f.dataType) for f in t} if isinstance(t, T.StructType) else make[t]()

        for _ in range(50):
            v = value(fields)
            b = b"\x00" + struct.pack(">i", 5) + avro.write(s, v)
            assert avro.decode(b, {5: avro.reader(s)}, {}) == (v, None)
            assert avro.decode(b + b"\x00", {5: avro.reader(s)}, {})[1] == avro.decode(b[:-1], {5: avro.reader(s)}, {})[1] == "DESERIALIZATION_ERROR"
            assert avro.decode(b, {}, {})[1] == "SCHEMA_ERROR"
    with pytest.raises(avro.SchemaError):
        avro.reader({"type": "record", "name": "R", "fields": [{"name": "x", "type": "double"}]})
    old, kinds = avro.record("D", schemas.DECISION_V1), {"type": "record", "name": "E", "fields": [{"name": "s", "type": {"type": "enum", "name": "S", "symbols": ["A", "B"]}}, {"name": "n", "type": ["null", "long"]}]}
    assert avro.decode(b"\x00\x00\x00\x00\x01" + avro.write(kinds, {"s": "B", "n": None}), {1: avro.reader(kinds)}, {}) == ({"s": "B", "n": None}, None)
    v1 = {f.name: [] if isinstance(f.dataType, T.ArrayType) else "x" if f.dataType == T.StringType() else 1 for f in schemas.DECISION_V1}
    assert avro.decode(b"\x00\x00\x00\x00\x01" + avro.write(old, v1), {1: avro.reader(old)}, schemas.DEFAULTS)[0]["policy_id"] == "dynamic"


def test_columns_are_encoded_and_decoded(spark):
    from pyspark.sql import functions as F

    s = avro.record("Transaction", schemas.TRANSACTION)
    rows = [tuple(pay(i, i).values()) for i in range(20)] + [tuple((pay("n", 1) | {"device_id": None}).values())]
    df = spark.createDataFrame(rows, schemas.TRANSACTION)
    wire = df.select("event_id", avro.encoded(F.struct(*schemas.TRANSACTION.names), s, 7).alias("payload"))
    assert wire.where("payload IS NULL").select("event_id").collect() == [("n",)]
    back = wire.select("event_id", avro.decoded(F.col("payload"), {7: s}, schemas.TRANSACTION).alias("r"))
    good = back.where("r.decode_error IS NULL").select("r.*").drop("decode_error")
    assert sorted(map(tuple, good.collect())) == sorted(rows[:20]) and back.where("r.decode_error = 'DESERIALIZATION_ERROR'").count() == 1

"""Look-back windows, scoring, identities, policies and validation."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import identity
from ledgerlens.functions.policy import Policy, Rule, rule_error
from ledgerlens.operators import identity_conflicts, lookback, validate
from ledgerlens.operators.score import score
from ledgerlens.plans.reference import POLICY
from ledgerlens.sources import schemas
from ledgerlens.streaming.scoring import decide, observe

TX = "event_id string, transaction_id string, customer_id string, merchant_id string, amount_minor long, currency string, country string, device_id string, status string, event_time long, producer_time long"


def tx(i, t, amount=10, device="d0", status="APPROVED", customer="C1", currency="EUR"):
    return (f"{i}", f"txn-{i}", customer, "M1", amount, currency, "IT", device, status, t, t)


def scores(spark, rows, policy=POLICY):
    return {r.event_id: r for r in score(spark.createDataFrame(rows, TX), policy, F.col("event_time") + 1).collect()}


def test_all_rules(spark):
    rows = [tx(i, 1_000_000 + i * 20_000, 90_000, f"d{i}", "DECLINED" if i < 4 else "APPROVED") for i in range(6)]
    last = scores(spark, rows)["5"]
    assert (last.risk_score, last.decision, list(last.matched_rules)) == (100, "REJECT", ["R001", "R002", "R003", "R004", "R005"])
    assert len(last.rule_evidence) == 5 and last.evaluation_id.startswith("eval_") and last.decision_id == "risk_txn-5"


def one(rule, **changes):
    return Policy("p", 1, (replace(rule, **changes),), 30, 70)


def test_lower_bound_is_outside(spark):
    p = one(POLICY.rules[0], threshold=1)
    assert scores(spark, [tx("a", 80_000), tx("b", 200_000)], p)["b"].risk_score == 0
    assert scores(spark, [tx("a", 80_000), tx("b", 199_999)], p)["b"].risk_score == 25


def test_ties_count_in_the_order_of_ids(spark):
    got = scores(spark, [tx(x, 500) for x in "cab"], one(POLICY.rules[0], threshold=1))
    assert [got[x].rule_evidence[0].observed for x in "abc"] == [1, 2, 3]


def test_new_device(spark):
    rows = [tx("a", 999_000, device="known"), tx("b", 1_000_000, 80_000, "known"), tx("c", 1_000_000, 80_000, "new", customer="C2")]
    got = scores(spark, rows)
    assert got["b"].decision == "APPROVE" and got["c"].decision == "REVIEW"


def test_disabled_and_other_currency(spark):
    off = one(POLICY.rules[1], enabled=False)
    r = scores(spark, [tx("a", 1000, 500_000)], off)["a"]
    assert r.risk_score == 0 and r.rule_evidence[0].observed == 500_000 and not r.rule_evidence[0].matched
    rows = [tx("a", 1000, 999_999, currency="USD"), tx("b", 2000, 100)]
    assert scores(spark, rows, one(POLICY.rules[1]))["b"].rule_evidence[0].observed == 100


@pytest.mark.parametrize("cell_ms", [200_000, 3_600_000, 86_400_000])
def test_windows_equal_a_plain_scan(spark, cell_ms):
    rng = random.Random(42)
    rows, t = [], 10_000_000
    for i in range(600):
        t += rng.choice([0, 0, 1, 1000, 119_999, 120_000, 120_001, 600_000]) if i % 151 else 4_000_000
        rows.append(tx(f"e{rng.randint(0, 10**9)}-{i}", t, rng.randint(1, 100_000), f"d{rng.randint(0, 5)}", rng.choice(["APPROVED", "DECLINED"]), rng.choice(["hot", "hot", "cold"])))
    rules = (*POLICY.rules[:3], replace(POLICY.rules[3], window_seconds=900), POLICY.rules[4])
    got = {r.event_id: r for r in lookback.observations(spark.createDataFrame(rows, TX), rules, cell_ms).collect()}
    assert len(got) == len(rows)
    names = [f.split()[0] for f in TX.split(", ")]
    past, seen = {}, {}
    for row in sorted(rows, key=lambda r: (r[9], r[0])):
        d = dict(zip(names, row))
        h = past.setdefault(d["customer_id"], [])
        for r in rules:
            want = observe(r, d, h, seen.get((d["customer_id"], d["device_id"])))
            assert (got[d["event_id"]][f"o_{r.rule_id}"], got[d["event_id"]][f"e_{r.rule_id}"]) == want
        h.append(d)
        seen[d["customer_id"], d["device_id"]] = d["event_time"]


def test_scalar_scoring_agrees():
    past = [dict(event_time=1000, amount_minor=1, currency="EUR", device_id="x", status="DECLINED")] * 4
    d = decide(POLICY, dict(event_time=2000, amount_minor=90_000, currency="EUR", device_id="y", status="APPROVED"), past, None)
    assert d == {"risk_score": 70, "decision": "REJECT", "matched_rules": ["R004", "R005"], "observed": [5, 90_004, 2, 90_000, 4]}


def test_policy():
    p = Policy("p", 1, tuple(reversed(POLICY.rules)), 30, 70)
    assert p.fingerprint() == POLICY.fingerprint() == "44678769d6cf7aedd5f72c77a0e0d1b4f714b3445ff778a469decc87fc767a94"
    assert replace(p, rules=(replace(p.rules[0], threshold=999), *p.rules[1:])).fingerprint() != p.fingerprint()
    assert Policy.read('{"policy_id":"p","version":1,"review_threshold":30,"reject_threshold":70,"rules":[{"rule_id":"R001","version":1,"type":"TX_COUNT_VELOCITY","enabled":true,"score":25,"window_seconds":120,"threshold":5,"currency":"EUR","updated_at":0}]}').rules[0].score == 25
    for bad in (dict(review=70), dict(reject=101), dict(policy_id="a b"), dict(version=0), dict(rules=(p.rules[0], p.rules[0]))):
        with pytest.raises(ValueError):
            replace(p, **bad)
    rule = dict(rule_id="R001", version=1, type="TX_COUNT_VELOCITY", enabled=True, score=1, window_seconds=3600, threshold=0, currency="EUR", updated_at=0)
    assert rule_error(rule) is None and rule_error({**rule, "window_seconds": 3601}) and rule_error({**rule, "score": True}) and rule_error({**rule, "type": "X"}) == "UNKNOWN_RULE_TYPE"
    with pytest.raises(ValueError):
        Policy("p", 1, (Rule("R001", 1, "X", True, 1, 1, 1),), 30, 70)


def test_identities(spark):
    assert identity.canonical({"z": [{"b": 2, "a": 1}, None, True, "é"], "a": -12.5}) == '{"a":-12.5,"z":[{"a":1,"b":2},null,true,"é"]}'
    df = spark.createDataFrame([('e"1\\é', 3)], "e string, v long")
    got = df.select(identity.evaluation_id(F.col("e"), F.lit("x/1"), F.lit("p"), F.col("v")), identity.legacy_evaluation_id(F.col("e"))).first()
    assert got[0] == "eval_" + identity.sha256_text(identity.canonical(['e"1\\é', "x/1", "p", 3]))
    assert got[1] == "eval_" + identity.sha256_text(identity.canonical(['e"1\\é', "legacy", "dynamic", 0]))


def test_validation_order_and_dead_letters(spark):
    good = tx("a", 1000)
    rows = [good, *[tuple(v if f != k else w for f, v in zip([x.split()[0] for x in TX.split(", ")], good)) for k, w in [("device_id", " "), ("device_id", "x" * 129), ("amount_minor", 0), ("amount_minor", None), ("currency", "eur"), ("country", "ITA"), ("status", "X"), ("event_time", 301_001)]]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TX + ", i int")
    codes = [r[0] for r in df.orderBy("i").select(validate.error_code(F.lit(1000))).collect()]
    assert codes == [None, "MISSING_REQUIRED_FIELD", "MISSING_REQUIRED_FIELD", "INVALID_AMOUNT", "INVALID_AMOUNT", "INVALID_CURRENCY", "INVALID_COUNTRY", "INVALID_STATUS", "INVALID_EVENT_TIME"]
    wire = spark.createDataFrame([("t", 0, 1, 5, bytearray(b"\x00\x00\x00\x01\x02body"), "SCHEMA_ERROR: x"), ("t", 0, 2, 5, bytearray(b"z" * 5000), "what"), ("t", 0, 3, 5, None, None)], "source_topic string, source_partition int, source_offset long, source_timestamp long, payload binary, error_code string")
    kept = validate.dead_letters(wire, mode="capture", observed_at=F.lit(9)).orderBy("source_offset").collect()
    assert [(r.schema_id, r.error_code, r.payload_truncated, r.payload_bytes) for r in kept] == [(258, "SCHEMA_ERROR", False, 9), (-1, "DESERIALIZATION_ERROR", True, 5000), (-1, "DESERIALIZATION_ERROR", False, 0)]
    assert set(validate.dead_letters(wire).columns) == {f.name for f in schemas.DEAD_LETTER.fields}


def test_outcome_rows(spark):
    t = '{"event_id":"e","customer_id":"c","event_time":100,"amount_minor":5}'
    rows = [(t, "c", 150, 50, 9, "R"), (t, "c", 150, 49, 9, "R"), (t, "c", 150, None, 9, "R"), (t, "c", 99, -1, 9, "R"), (t, None, 150, 50, 9, "R"), (t, "d", 150, 50, 9, None), (t, "c", 150, 50, 0, "R"), (t, "c", 150, 50, None, "R"), ("{", "c", 150, 50, 9, "R"), (None, None, 0, 0, 9, "R"), (t, "c", 100, 0, 9, "R")]
    late = spark.createDataFrame([(*r,) for r in rows], schemas.LATE_EVENT)
    got = validate.late_outcomes(late.coalesce(1)).collect()
    assert [r.row_error for r in got] == [None, "LATENESS", "LATENESS", "WATERMARK", "CUSTOMER", "CUSTOMER", "OBSERVED_AT", "OBSERVED_AT", "EVENT", "EVENT", None]
    assert (got[0].outcome, got[0].event_id, got[0].lateness_ms, got[0].reason, got[5].reason) == ("LATE", "e", 50, "R", "")
    h = "a" * 64
    letters = [("t", 0, 1, 9, h, "X"), (" ", 0, 1, 9, h, "X"), ("t", -1, 1, 9, h, "X"), ("t", 0, None, 9, h, "X"), ("t", 0, 1, 0, h, "X"), ("t", 0, 1, 9, h[1:], "X"), ("t", 0, 1, 9, h.upper(), "X"), ("t", 0, 1, 9, h, " "), ("t", 0, 1, 9, h, None)]
    df = spark.createDataFrame(letters, "source_topic string, source_partition int, source_offset long, observed_at long, payload_sha256 string, error_code string")
    bad = validate.invalid_outcomes(df.coalesce(1))
    assert [r.row_error for r in bad.collect()] == [None, "COORDINATES", "COORDINATES", "COORDINATES", "OBSERVED_AT", "HASH", "HASH", "CODE", "CODE"]
    assert bad.columns == validate.late_outcomes(late).columns


def test_identity_conflicts(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("b", 1, 1), ("b", 2, 2), (None, 1, 1)], "k string, v int, o int")
    firsts = identity_conflicts.first_of_each(df, "k", ["o"])
    assert {(r.k, r.v, r.o, r.copies, r.variants) for r in firsts.collect()} == {("a", 1, 4, 2, 1), ("b", 1, 1, 2, 2)}
    with pytest.raises(identity_conflicts.IdentityConflict):
        identity_conflicts.require_none(identity_conflicts.conflicts(firsts, "k"), "k")
    identity_conflicts.require_none(identity_conflicts.conflicts(firsts.where("k = 'a'"), "k"), "k")


def test_older_writers(spark):
    old = spark.createDataFrame([("risk_1", "e")], "decision_id string, event_id string")
    r = schemas.upgraded(old, schemas.DECISION).first()
    assert (r.engine_version, r.policy_id, r.policy_version, r.evaluation_id, r.rule_evidence, r.matched_rules) == ("legacy", "dynamic", 0, "", [], [])

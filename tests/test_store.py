"""Settings, catalogues, the store and its quarantine, offsets."""

import json
from dataclasses import asdict, replace

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.functions import identity, policy
from ledgerlens.operators import reconcile, store, validate
from ledgerlens.plans.reference import POLICY
from ledgerlens.settings import Settings
from ledgerlens.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_settings_have_bounds():
    s = Settings()
    assert Settings.of({}) == s and Settings.of({"LEDGERLENS_REVIEW": "40", "LEDGERLENS_TOPIC_PREFIX": "eu."}).topics["rules"] == "eu.risk.rules"
    for bad in (
        dict(environment="test"), dict(environment="staging", dlq_payload="capture"), dict(pending_alert_ms=999), dict(topics={"a": "x", "b": "x"}), dict(topics={"a": "x y"}), dict(disorder_ms=-1),
        dict(history_ms=899_999), dict(device_ms=2_591_999_999), dict(history_ms=3_000_000_000), dict(review=70), dict(reject=101), dict(start="latest"), dict(max_events=0),
    ):
        with pytest.raises(ValueError):
            replace(s, **bad)


def text(p, **changes):
    return json.dumps({"policy_id": p.policy_id, "version": p.version, "review_threshold": p.review, "reject_threshold": p.reject, "rules": [asdict(r) for r in p.rules]} | changes)


def test_catalogue_wants_five_distinct_rules():
    later = replace(POLICY, version=2, review=70, reject=90)
    assert set(policy.catalogue(text(POLICY), text(later), text(POLICY))) == {("default", 1), ("default", 2)}
    rules = [asdict(r) for r in POLICY.rules]
    for bad in (dict(rules=rules[:4]), dict(rules=rules[:4] + rules[:1]), dict(rules=rules + rules[:1]), dict(version=0), dict(version=1.5), dict(policy_id=5), dict(review_threshold=70), dict(rules=rules[:4] + [rules[4] | {"score": True}])):
        with pytest.raises(ValueError):
            policy.catalogue(text(POLICY, **bad))
    with pytest.raises(ValueError):
        policy.catalogue(text(POLICY), text(replace(POLICY, review=31)))


def test_results_are_stored_or_quarantined(spark, tmp_path):
    e = table(spark, SF, "evaluations")
    for _ in range(2):  # a batch that runs again replaces what it wrote
        store.materialise(e, str(tmp_path), 3, 5)
    kept, out = (spark.read.parquet(str(tmp_path / t)) for t in ("evaluations", "materializer_rejections"))
    assert kept.count() + out.count() == e.count() and kept.where("evaluation_id IS NULL OR evaluation_id = ''").count() == 0
    legacy = e.where("coalesce(evaluation_id, '') = '' AND decision IS NOT NULL AND processed_at IS NOT NULL")
    want = {r[0] for r in legacy.select(identity.legacy_evaluation_id(F.col("event_id"))).collect()}
    assert want and want <= {r[0] for r in kept.select("evaluation_id").collect()}
    assert {r[0] for r in out.select("error_code").collect()} <= {"INVALID_DECISION", "INVALID_EVALUATION_ID"} and out.where("length(payload_sha256) = 64").count() == out.count()
    with pytest.raises(ValueError):
        store.append(e, str(tmp_path), "payments")


def test_a_reader_never_skips_records(spark):
    log = lambda *o: spark.createDataFrame([("t", 0, x) for x in o], "source_topic string, source_partition int, source_offset long")
    reconcile.require_whole(log(0, 1, 5))
    reconcile.require_whole(log(4, 5), {("t", 0): 4})
    for bad, at in ((log(1, 2), None), (log(5, 6), {("t", 0): 4})):
        with pytest.raises(reconcile.GapError):
            reconcile.require_whole(bad, at)
    assert reconcile.acknowledged(log(3, 9, 4)).first().next_offset == 10


def test_countries_are_those_of_iso_3166(spark):
    rows = spark.createDataFrame([("IT",), ("XX",), ("it",), (None,), ("GB",), ("UK",)], "country string")
    known = rows.where(F.col("country").isin(*validate.iso_countries())).collect()
    assert {r[0] for r in known} == {"IT", "GB"} and len(validate.iso_countries()) > 240


def test_base64_has_no_line_ends(spark):
    letters = validate.dead_letters(spark.createDataFrame([("t", 0, 1, 2, bytearray(range(256)), "INVALID_AMOUNT")], "source_topic string, source_partition int, source_offset long, source_timestamp long, payload binary, error_code string"), mode="capture")
    assert len(letters.first().raw_payload) == 344 and "\n" not in letters.first().raw_payload


def test_one_customers_decisions_are_those_of_the_view(spark, monkeypatch):
    e = table(spark, SF, "evaluations")
    both = e.unionByName(e.limit(40).withColumn("customer_id", F.lit("other")))  # identities that customers share
    every = store.decisions_current(both)
    ids = [r[0] for r in e.groupBy("customer_id").count().orderBy(F.desc("count")).limit(3).collect()] + ["other"]
    for limit in (session.BROADCAST_ROWS, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        for c in ids:
            got, want = ({(r.evaluation_id, r.event_time, r.rule_evidence) for r in df.collect()} for df in (store.decisions_of(both, c), every.where(F.col("customer_id") == c)))
            assert got == want

"""Evidence, score and decision of observed payments, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import identity
from ledgerlens.functions.policy import Policy
from ledgerlens.operators.lookback import observations


def evidence(policy: Policy) -> Column:
    """One entry per rule, in the order of rule ids, those that did not match included."""
    entries = []
    for r in policy.rules:
        matched = F.col(f"m_{r.rule_id}")
        entries.append(
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.version).cast("bigint").alias("rule_version"),
                F.lit(r.type).alias("type"),
                F.lit(r.enabled).alias("enabled"),
                F.lit(r.window_seconds).cast("bigint").alias("window_seconds"),
                F.lit(r.threshold).cast("bigint").alias("threshold"),
                F.col(f"o_{r.rule_id}").cast("bigint").alias("observed"),
                F.col(f"e_{r.rule_id}").alias("eligible"),
                matched.alias("matched"),
                F.when(matched, r.score).otherwise(0).alias("score_contribution"),
            )
        )
    return F.array(*entries)


def score(payments: DataFrame, policy: Policy, processed_at: Column) -> DataFrame:
    """Decisions in the schema of schemas.DECISION. processed_at is a parameter, as results must
    not depend on a clock."""
    seen = observations(payments, policy.rules).withColumn("rule_evidence", evidence(policy))
    hit = F.filter("rule_evidence", lambda e: e["matched"])
    total = F.aggregate("rule_evidence", F.lit(0), lambda a, e: a + e["score_contribution"])
    scored = seen.withColumn("risk_score", F.least(F.lit(100), total).cast("int"))
    engine, pid, version = F.lit(identity.ENGINE), F.lit(policy.policy_id), F.lit(policy.version).cast("bigint")
    return scored.select(
        identity.decision_id(F.col("transaction_id")).alias("decision_id"),
        "event_id", "transaction_id", "customer_id", "amount_minor", "currency", "risk_score",
        F.when(F.col("risk_score") >= policy.reject, "REJECT").when(F.col("risk_score") >= policy.review, "REVIEW").otherwise("APPROVE").alias("decision"),
        F.transform(hit, lambda e: e["rule_id"]).alias("matched_rules"),
        F.transform(hit, lambda e: e["type"]).alias("reason_codes"),
        F.lit(policy.fingerprint()).alias("rules_fingerprint"),
        "event_time", processed_at.cast("bigint").alias("processed_at"),
        identity.evaluation_id(F.col("event_id"), engine, pid, version).alias("evaluation_id"),
        engine.alias("engine_version"), F.lit(policy.snapshot()).alias("policy_snapshot"), pid.alias("policy_id"), version.alias("policy_version"),
        "rule_evidence", identity.input_hash().alias("input_sha256"),
    )

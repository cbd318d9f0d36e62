"""Rule sets as data: validation, snapshot and fingerprint, on the driver (a handful of rows)."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.identity import canonical, sha256_text

DYNAMIC = "dynamic"  # the id of rules that are updated one by one; its version is 0
HISTORY_S, DEVICE_S = 3_600, 2_592_000
# The kinds of rules and the comparison each makes
TYPES = {
    "TX_COUNT_VELOCITY": ">",
    "AMOUNT_VELOCITY": ">",
    "UNIQUE_DEVICES": ">=",
    "NEW_DEVICE_HIGH_AMOUNT": ">=",
    "DECLINE_THEN_APPROVAL": ">=",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    type: str
    enabled: bool
    score: int
    window_seconds: int
    threshold: int
    currency: str = "EUR"
    updated_at: int = 0


def rule_error(rule: dict[str, Any], history_s: int = HISTORY_S, device_s: int = DEVICE_S) -> str | None:
    """The error code of a rule as read, or None."""
    ints = ("version", "score", "window_seconds", "threshold", "updated_at")
    whole = all(type(rule.get(f)) is int and -(1 << 63) <= rule[f] < 1 << 63 for f in ints)
    if not whole or not -(1 << 31) <= rule["score"] < 1 << 31:
        return "INVALID_RULE_CONFIGURATION"
    if rule.get("type") not in TYPES:
        return "UNKNOWN_RULE_TYPE"
    longest = device_s if rule["type"] == "NEW_DEVICE_HIGH_AMOUNT" else history_s
    good = (
        re.fullmatch("R00[1-5]", str(rule.get("rule_id")))
        and rule["version"] >= 1
        and 0 <= rule["score"] <= 100
        and 1 <= rule["window_seconds"] <= longest
        and rule["threshold"] >= 0
        and isinstance(rule.get("enabled"), bool)
        and rule.get("currency") == "EUR"
        and rule["updated_at"] >= 0
    )
    return None if good else "INVALID_RULE_CONFIGURATION"


def rule_error_column(history_s: int = HISTORY_S, device_s: int = DEVICE_S) -> Column:
    """The same check over rows of a rule log: null where the rule is valid."""
    longest = F.when(F.col("type") == "NEW_DEVICE_HIGH_AMOUNT", F.lit(device_s)).otherwise(F.lit(history_s))
    ints = [F.col(c).isNull() for c in ("version", "score", "window_seconds", "threshold", "updated_at")]
    missing = ints[0]
    for c in ints[1:]:
        missing = missing | c
    good = (
        F.col("rule_id").rlike(r"^R00[1-5]\z")
        & (F.col("version") >= 1)
        & F.col("score").between(0, 100)
        & F.col("window_seconds").between(F.lit(1), longest)
        & (F.col("threshold") >= 0)
        & F.col("enabled").isNotNull()
        & (F.col("currency") == "EUR")
        & (F.col("updated_at") >= 0)
    )
    bad = F.lit("INVALID_RULE_CONFIGURATION")
    return F.when(missing, bad).when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), F.lit("UNKNOWN_RULE_TYPE")).when(~F.coalesce(good, F.lit(False)), bad)


@dataclass(frozen=True)
class Policy:
    policy_id: str
    version: int
    rules: tuple[Rule, ...]
    review: int
    reject: int

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(sorted(self.rules, key=lambda r: r.rule_id)))
        good = (
            re.fullmatch(r"[a-zA-Z0-9._-]{1,128}", self.policy_id)
            and (self.version >= 1 or (self.policy_id == DYNAMIC and self.version == 0))
            and len({r.rule_id for r in self.rules}) == len(self.rules)
            and 1 <= self.review < self.reject <= 100
            and all(rule_error(asdict(r)) is None for r in self.rules)
        )
        if not good:
            raise ValueError("invalid policy")

    @classmethod
    def read(cls, text: str) -> Policy:
        p = json.loads(text)
        return cls(p["policy_id"], p["version"], tuple(Rule(**r) for r in p["rules"]), p["review_threshold"], p["reject_threshold"])

    def snapshot(self) -> str:
        return canonical({"reject_threshold": self.reject, "review_threshold": self.review, "rules": [asdict(r) for r in self.rules]})

    def fingerprint(self) -> str:
        """Independent of the order of rules; every parameter counts. The inner objects are texts."""
        return sha256_text(f"{self.review}:{self.reject}:" + canonical({r.rule_id: canonical(asdict(r)) for r in self.rules}))


def updated(base: Policy, log: DataFrame) -> Policy:
    """The rules of base with the updates of a log: of every rule the valid row with the highest version,
    if that is above the one of base. A handful of rows reach the driver."""
    good = log.where(rule_error_column().isNull()).select("rule_id", "version", "type", "enabled", "score", "window_seconds", "threshold", "currency", "updated_at")
    rest = F.struct(*[c for c in good.columns if c != "rule_id"])  # version first; of equal versions the greatest row
    newest = good.groupBy("rule_id").agg(F.max(rest).alias("r")).select("rule_id", "r.*").collect()
    rules = {r.rule_id: r for r in base.rules}
    for r in newest:
        if r.rule_id not in rules or r.version > rules[r.rule_id].version:
            rules[r.rule_id] = Rule(**r.asDict())
    return Policy(DYNAMIC, 0, tuple(rules.values()), base.review, base.reject)


RULES = 5


def catalogue(*texts: str) -> dict[tuple[str, int], Policy]:
    """The policies of a catalogue, JSON texts, by id and version. A policy of a catalogue has exactly
    RULES rules, whole numbers where numbers belong, and no second policy has its id and version."""
    out: dict[tuple[str, int], Policy] = {}
    for text in texts:
        p = json.loads(text)
        whole = all(type(p.get(f)) is int and -(1 << 63) <= p[f] < 1 << 63 for f in ("version", "review_threshold", "reject_threshold"))
        if not isinstance(p.get("policy_id"), str) or not whole or not isinstance(p.get("rules"), list) or len(p["rules"]) != RULES:
            raise ValueError("invalid policy catalogue")
        for r in p["rules"]:
            if rule_error(r):
                raise ValueError(f"invalid rule in the catalogue: {rule_error(r)}")
        policy = Policy.read(text)
        if out.setdefault((policy.policy_id, policy.version), policy) != policy:
            raise ValueError("two policies of one id and version")
    return out


def releases(log: DataFrame) -> DataFrame:
    """(policy_id, policy_version, rules, complete): every policy version of a rule log with the number
    of rules in force at it, the highest version of each that came with it or before. A version is
    complete with RULES valid rules. Equal to the check of a catalogue, over a log."""
    from pyspark.sql import Window

    one = log.withColumn("_bad", rule_error_column().isNotNull()).groupBy("policy_id", "rule_id", "policy_version").agg(F.max(F.struct("version", ~F.col("_bad"))).alias("_top"))
    at = one.select("policy_id", "policy_version").distinct()
    known = one.select("policy_id", "rule_id").distinct()
    # versions x rules of a policy, both a handful; the running maximum is over them
    grid = at.join(known, "policy_id").join(one, ["policy_id", "rule_id", "policy_version"], "left")
    upto = Window.partitionBy("policy_id", "rule_id").orderBy("policy_version").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.withColumn("_held", F.max("_top").over(upto)).where(F.col("_held").isNotNull())
    out = held.groupBy("policy_id", "policy_version").agg(F.count(F.lit(1)).alias("rules"), F.bool_and(F.col("_held.col2")).alias("_valid"))
    return out.select("policy_id", "policy_version", "rules", ((F.col("rules") == RULES) & F.col("_valid")).alias("complete"))


def latest_rules(log: DataFrame) -> DataFrame:
    """The highest version of every (policy_id, rule_id): updates with a version not above the
    one in force change nothing; of rows with the same version the first offset counts."""
    fields = [c for c in log.columns if c not in ("policy_id", "rule_id")]
    best = F.struct(F.col("version"), (-F.col("source_offset")).alias("o"))
    top = log.groupBy("policy_id", "rule_id").agg(F.max_by(F.struct(*fields), best).alias("_r"))
    return top.select("policy_id", "rule_id", *[F.col(f"_r.{c}").alias(c) for c in fields])

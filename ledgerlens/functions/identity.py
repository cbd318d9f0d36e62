"""Canonical JSON, content hashes and identities."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ENGINE = "ledgerlens/0.1.0"
FACTS = ("amount_minor", "country", "currency", "customer_id", "device_id", "event_id", "event_time", "merchant_id", "status", "transaction_id")


def canonical(value: object) -> str:
    """Compact JSON with sorted keys; other than ASCII characters stay as they are. For values on
    the driver; columns of a fixed schema use canonical_struct."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_struct(*columns: str) -> Column:
    """Canonical JSON of columns: fields by name; null fields are kept as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def input_hash() -> Column:
    """Hash of a transaction's facts: all fields but the producer's clock."""
    return F.sha2(canonical_struct(*FACTS), 256)


def evaluation_id(event_id: Column, engine: Column, policy_id: Column, policy_version: Column) -> Column:
    """One identity per event, engine release and policy release; results are no part of it."""
    texts = F.array(event_id, engine, policy_id)
    head = F.substring(F.to_json(texts), F.lit(1), F.length(F.to_json(texts)) - 1)
    return F.concat(F.lit("eval_"), F.sha2(F.concat(head, F.lit(","), policy_version.cast("string"), F.lit("]")), 256))


def legacy_evaluation_id(event_id: Column) -> Column:
    return evaluation_id(event_id, F.lit("legacy"), F.lit("dynamic"), F.lit(0))


def decision_id(transaction_id: Column) -> Column:
    return F.concat(F.lit("risk_"), transaction_id)

"""Typed records of the streams, and rows of older writers brought to the current schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TRANSACTION = _struct(event_id=_S, transaction_id=_S, customer_id=_S, merchant_id=_S, amount_minor=_L, currency=_S, country=_S, device_id=_S, status=_S, event_time=_L, producer_time=_L)
COORDINATES = _struct(source_topic=_S, source_partition=_I, source_offset=_L, source_timestamp=_L)
RULE = _struct(rule_id=_S, version=_L, type=_S, enabled=_B, score=_I, window_seconds=_L, threshold=_L, currency=_S, updated_at=_L)
EVIDENCE = _struct(rule_id=_S, rule_version=_L, type=_S, enabled=_B, window_seconds=_L, threshold=_L, observed=_L, eligible=_B, matched=_B, score_contribution=_I)
DECISION_V1 = _struct(decision_id=_S, event_id=_S, transaction_id=_S, customer_id=_S, amount_minor=_L, currency=_S, risk_score=_I, decision=_S, matched_rules=T.ArrayType(_S), reason_codes=T.ArrayType(_S), rules_fingerprint=_S, event_time=_L, processed_at=_L)
DECISION = T.StructType(DECISION_V1.fields + _struct(evaluation_id=_S, engine_version=_S, policy_snapshot=_S, policy_id=_S, policy_version=_L, rule_evidence=T.ArrayType(EVIDENCE), input_sha256=_S).fields)
LATE_EVENT = _struct(transaction=_S, customer_id=_S, watermark=_L, lateness_ms=_L, observed_at=_L, reason=_S)
DEAD_LETTER = _struct(error_id=_S, source_topic=_S, source_partition=_I, source_offset=_L, source_timestamp=_L, schema_id=_I, observed_at=_L, error_code=_S, error_message=_S, raw_payload=_S, payload_truncated=_B, payload_sha256=_S, payload_bytes=_L, payload_mode=_S)

# What a reader takes for fields that an older writer did not know
DEFAULTS = {
    "evaluation_id": "",
    "engine_version": "legacy",
    "policy_snapshot": "",
    "policy_id": "dynamic",
    "policy_version": 0,
    "input_sha256": "",
    "source_timestamp": -1,
    "schema_id": -1,
    "payload_sha256": "",
    "payload_bytes": 0,
    "payload_mode": "legacy-capture",
}


def upgraded(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the reader's schema: missing columns get the reader's default (an empty array for
    arrays, else null where there is none); columns the reader does not know are dropped."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array().cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)

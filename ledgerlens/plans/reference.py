"""Queries over the payment, evaluation and rule tables, and their SQL.

The scoring queries read card payments derived from `events` (time compressed, so that
windows of minutes fill); the others read `payments`, `evaluations`, `risk_rules` and
`late_events` as they are. Clocks are parameters: ANCHOR_MS stands for now.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import identity, policy
from ledgerlens.functions.policy import Policy, Rule
from ledgerlens.operators import bitemporal, identity_conflicts, late_periods, lookback, overview, reconcile, store, validate
from ledgerlens.operators.score import score
from ledgerlens.session import materialize
from ledgerlens.sources.tables import table

ANCHOR_MS = 1_748_563_200_000  # 2025-05-30T00:00Z, the end of the data
DISORDER_MS = 10_001
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The default policy of the fixtures
POLICY = Policy(
    "default",
    1,
    (
        Rule("R001", 1, "TX_COUNT_VELOCITY", True, 25, 120, 5),
        Rule("R002", 1, "AMOUNT_VELOCITY", True, 35, 600, 300_000),
        Rule("R003", 1, "UNIQUE_DEVICES", True, 20, 900, 3),
        Rule("R004", 1, "NEW_DEVICE_HIGH_AMOUNT", True, 30, 2_592_000, 80_000),
        Rule("R005", 1, "DECLINE_THEN_APPROVAL", True, 40, 600, 4),
    ),
    30,
    70,
)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def card_payments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    time = F.lit(1_704_067_200_000) + F.floor(F.floor(us / 500_000) / 5_000) * 5_000
    return e.select(
        text("evt-", F.col("event_id")).alias("event_id"),
        text("txn-evt-", F.col("event_id")).alias("transaction_id"),
        text("cust-", F.col("user_id")).alias("customer_id"),
        F.lit("merchant-1").alias("merchant_id"),
        F.greatest(F.lit(1), F.round(F.col("value") * 400).cast("bigint")).alias("amount_minor"),
        F.lit("EUR").alias("currency"),
        F.lit("IT").alias("country"),
        text("dev-", F.get_json_object("props", "$.k").cast("int") % 24).alias("device_id"),
        F.when(F.col("event_type").isin("error", "view"), "DECLINED").otherwise("APPROVED").alias("status"),
        time.alias("event_time"),
        time.alias("producer_time"),
    )


_CARD = """card AS (
  SELECT 'evt-' || event_id AS event_id, 'txn-evt-' || event_id AS transaction_id, 'cust-' || user_id AS customer_id, 'merchant-1' AS merchant_id,
         greatest(1, CAST(round(value * 400) AS BIGINT)) AS amount_minor, 'EUR' AS currency, 'IT' AS country,
         'dev-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 24) AS device_id,
         CASE WHEN event_type IN ('error', 'view') THEN 'DECLINED' ELSE 'APPROVED' END AS status,
         1704067200000 + ((epoch_us(ts) - 1704067200000000) // 500000 // 5000 * 5000) AS event_time
  FROM events)"""
_BEFORE = "h.customer_id = c.customer_id AND (h.event_time < c.event_time OR (h.event_time = c.event_time AND h.event_id < c.event_id))"


def _seen(rule: Rule) -> str:
    """SQL of one rule over `card`: event_id, observed, eligible."""
    w = rule.window_seconds * 1000
    near = f"{_BEFORE} AND h.event_time > c.event_time - {w}"
    by = {
        "TX_COUNT_VELOCITY": ("1 + count(h.event_id)", "true"),
        "AMOUNT_VELOCITY": ("CAST(c.amount_minor + coalesce(sum(h.amount_minor), 0) AS BIGINT)", "true"),
        "UNIQUE_DEVICES": ("count(DISTINCT h.device_id) + CASE WHEN count(*) FILTER (h.device_id = c.device_id) > 0 THEN 0 ELSE 1 END", "true"),
        "NEW_DEVICE_HIGH_AMOUNT": ("c.amount_minor", f"coalesce(max(h.event_time) FILTER (h.device_id = c.device_id) <= c.event_time - {w}, true)"),
        "DECLINE_THEN_APPROVAL": ("count(*) FILTER (h.status = 'DECLINED')", "c.status = 'APPROVED'"),
    }[rule.type]
    if rule.type == "NEW_DEVICE_HIGH_AMOUNT":
        near = _BEFORE
    sign = policy.TYPES[rule.type]
    return f"""SELECT event_id, '{rule.rule_id}' AS rule_id, '{rule.type}' AS kind, observed, eligible, {str(rule.enabled).lower()} AND eligible AND observed {sign} {rule.threshold} AS matched, {rule.score} AS score FROM (
  SELECT c.event_id, {by[0]} AS observed, {by[1]} AS eligible FROM card c LEFT JOIN card h ON {near}
  GROUP BY c.event_id, c.amount_minor, c.device_id, c.status, c.event_time)"""


_ALL = f"WITH {_CARD}, seen AS ({' UNION ALL '.join(_seen(r) for r in POLICY.rules)})"
_SCORED = f"""{_ALL}, scored AS (
  SELECT c.event_id, c.transaction_id, c.customer_id, least(100, CAST(coalesce(sum(score) FILTER (matched), 0) AS INTEGER)) AS risk_score,
         coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (matched), '') AS matched_rules,
         coalesce(string_agg(kind, ',' ORDER BY rule_id) FILTER (matched), '') AS reason_codes
  FROM seen s JOIN card c USING (event_id) GROUP BY 1, 2, 3),
decided AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'REJECT' WHEN risk_score >= 30 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM scored)"""


def _rule_query(name: str, rule: Rule) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = rule.rule_id
        return lookback.observations(card_payments(spark, d), [rule]).select("event_id", F.col(f"o_{r}").alias("observed"), F.col(f"e_{r}").alias("eligible"), F.col(f"m_{r}").alias("matched"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_CARD} SELECT event_id, observed, eligible, matched FROM ({_seen(rule)})"


for _r in POLICY.rules:
    _rule_query(_r.type.lower(), _r)
_rule_query("unique_devices_6", Rule("R003", 1, "UNIQUE_DEVICES", True, 20, 900, 6))
_rule_query("disabled_rule", Rule("R002", 1, "AMOUNT_VELOCITY", False, 35, 600, 300_000))
_rule_query("amount_hour", Rule("R002", 1, "AMOUNT_VELOCITY", True, 35, 3_600, 900_000))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    p = card_payments(spark, d)
    return score(p, POLICY, F.col("event_time") + 10_000)


@query(f"WITH {_CARD} SELECT *, event_time AS producer_time FROM card")
def payments_scan(spark, d):
    return card_payments(spark, d)


@query(f"{_ALL} SELECT event_id, rule_id, CAST(observed AS BIGINT) AS observed, eligible, matched, CASE WHEN matched THEN score ELSE 0 END AS score_contribution FROM seen")
def rule_evidence_long(spark, d):
    e = _decisions(spark, d).select("event_id", F.explode("rule_evidence").alias("e"))
    return e.select("event_id", "e.rule_id", "e.observed", "e.eligible", "e.matched", "e.score_contribution")


@query(f"{_SCORED} SELECT event_id, customer_id, risk_score, decision, matched_rules, reason_codes FROM decided")
def score_decisions(spark, d):
    return _decisions(spark, d).select("event_id", "customer_id", "risk_score", "decision", F.array_join("matched_rules", ",").alias("matched_rules"), F.array_join("reason_codes", ",").alias("reason_codes"))


@query(f"{_SCORED} SELECT decision, count(*) AS n FROM decided GROUP BY 1")
def decision_counts(spark, d):
    return _decisions(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CARD} SELECT event_id, 'risk_' || transaction_id AS decision_id, 'eval_' || sha256('["' || event_id || '","{identity.ENGINE}","default",1]') AS evaluation_id FROM card""")
def evaluation_ids(spark, d):
    return _decisions(spark, d).select("event_id", "decision_id", "evaluation_id")


@query(f"""WITH {_CARD} SELECT event_id, sha256('{{"amount_minor":' || amount_minor || ',"country":"IT","currency":"EUR","customer_id":"' || customer_id || '","device_id":"' || device_id || '","event_id":"' || event_id
  || '","event_time":' || event_time || ',"merchant_id":"merchant-1","status":"' || status || '","transaction_id":"' || transaction_id || '"}}') AS input_sha256 FROM card""")  # fmt: skip
def input_hash(spark, d):
    return card_payments(spark, d).select("event_id", identity.input_hash().alias("input_sha256"))


@query(f"""{_SCORED}, c AS (
  SELECT count(*) FILTER (bad AND hit) AS tp, count(*) FILTER (NOT bad AND hit) AS fp, count(*) FILTER (bad AND NOT hit) AS fn, count(*) FILTER (NOT bad AND NOT hit) AS tn
  FROM (SELECT CAST(substr(event_id, 5) AS BIGINT) % 11 = 0 AS bad, risk_score >= 30 AS hit FROM decided))
SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS false_positive_rate FROM c""")  # fmt: skip
def confusion_matrix(spark, d):
    label = F.when(F.substring("event_id", 5, 20).cast("bigint") % 11 == 0, "SUSPICIOUS").otherwise("LEGITIMATE")
    return reconcile.confusion(_decisions(spark, d).withColumn("label", label))


# --- deliveries of payments -------------------------------------------------------------
# the codes of ISO 3166 as the time zone data list them; the operator asks the Java runtime
_COUNTRIES = ", ".join(f"'{line[:2]}'" for line in (files("tzdata") / "zoneinfo" / "iso3166.tab").read_text().splitlines() if line and not line.startswith("#"))
_CODE = f"""CASE
  WHEN coalesce(trim(event_id), '') = '' OR coalesce(trim(transaction_id), '') = '' OR coalesce(trim(customer_id), '') = '' OR coalesce(trim(merchant_id), '') = '' OR coalesce(trim(device_id), '') = ''
    OR greatest(length(event_id), length(transaction_id), length(customer_id), length(merchant_id), length(device_id)) > 128 THEN 'MISSING_REQUIRED_FIELD'
  WHEN NOT coalesce(amount_minor BETWEEN 1 AND 1000000000000, false) THEN 'INVALID_AMOUNT'
  WHEN NOT coalesce(currency = 'EUR', false) THEN 'INVALID_CURRENCY'
  WHEN NOT coalesce(country IN ({_COUNTRIES}), false) THEN 'INVALID_COUNTRY'
  WHEN NOT coalesce(status IN ('APPROVED', 'DECLINED'), false) THEN 'INVALID_STATUS'
  WHEN NOT coalesce(event_time > 0 AND event_time <= producer_time + 300000, false) THEN 'INVALID_EVENT_TIME' END"""


def _tagged(spark, d):
    return table(spark, d, "payments").withColumn("error_code", validate.error_code(F.col("producer_time")))


@query(f"SELECT source_partition, source_offset, error_code FROM (SELECT *, {_CODE} AS error_code FROM payments) WHERE error_code IS NOT NULL")
def validate_error_codes(spark, d):
    return validate.split_valid(table(spark, d, "payments"), validate.error_code(F.col("producer_time")))[1].select("source_partition", "source_offset", "error_code")


_PAYLOAD = "'\\x00\\x00\\x00\\x00\\x07'::BLOB || encode(repeat(event_id || coalesce(device_id, ''), 1 + source_offset % 400))"


def _wired(spark, d):
    """Payments with a payload in the framing of schema 7: of some hundred bytes to several thousand, null without an event_id."""
    said = F.expr("repeat(concat(event_id, coalesce(device_id, '')), cast(1 + source_offset % 400 as int))")
    return table(spark, d, "payments").withColumn("payload", F.concat(F.unhex(F.lit("0000000007")), F.encode(said, "utf-8")))


@query(f"""SELECT source_topic || ':' || source_partition || ':' || source_offset AS error_id, error_code, CASE WHEN p IS NULL THEN -1 ELSE 7 END AS schema_id, coalesce(base64(p[1:4096]), '') AS raw_payload,
  coalesce(octet_length(p) > 4096, false) AS payload_truncated, coalesce(sha256(p), sha256('')) AS payload_sha256, CAST(coalesce(octet_length(p), 0) AS BIGINT) AS payload_bytes
FROM (SELECT *, {_PAYLOAD} AS p, {_CODE} AS error_code FROM payments) WHERE error_code IS NOT NULL""")  # fmt: skip
def dlq_rows(spark, d):
    bad = validate.split_valid(_wired(spark, d), validate.error_code(F.col("producer_time")))[1]
    return validate.dead_letters(bad, mode="capture", observed_at=F.lit(ANCHOR_MS)).select("error_id", "error_code", "schema_id", "raw_payload", "payload_truncated", "payload_sha256", "payload_bytes")


@query(f"""SELECT source, error_code, count(*) AS n FROM (
  SELECT 'payments' AS source, {_CODE} AS error_code FROM payments
  UNION ALL SELECT 'late_events', 'INVALID_EVENT_TIME' FROM late_events WHERE lateness_ms IS NULL OR lateness_ms < 0) WHERE error_code IS NOT NULL GROUP BY 1, 2""")
def union_dlq(spark, d):
    late = table(spark, d, "late_events").where(F.col("lateness_ms").isNull() | (F.col("lateness_ms") < 0))
    both = _tagged(spark, d).where(F.col("error_code").isNotNull()).select(F.lit("payments").alias("source"), "error_code").unionByName(late.select(F.lit("late_events").alias("source"), F.lit("INVALID_EVENT_TIME").alias("error_code")))
    return both.groupBy("source", "error_code").agg(F.count(F.lit(1)).alias("n"))


_HASHED = " || ',' || ".join(f"""'"{f}":' || coalesce(CAST(json_extract(transaction, '$.{f}') AS VARCHAR), 'null')""" for f in identity.FACTS)


@query(f"""WITH t AS (
  SELECT *, json_extract_string(transaction, '$.event_id') AS e, json_extract_string(transaction, '$.customer_id') AS c, coalesce(TRY_CAST(json_extract_string(transaction, '$.event_time') AS BIGINT), 0) AS happened, sha256('{{' || {_HASHED} || '}}') AS h FROM late_events)
SELECT 'LATE' AS outcome, observed_at, '' AS input_topic, -1 AS input_partition, CAST(-1 AS BIGINT) AS input_offset, '' AS payload_sha256, e AS event_id, h AS input_sha256, coalesce(reason, '') AS reason, watermark, lateness_ms, CASE
  WHEN NOT coalesce(observed_at > 0, false) THEN 'OBSERVED_AT' WHEN coalesce(trim(e), '') = '' THEN 'EVENT' WHEN c IS DISTINCT FROM customer_id THEN 'CUSTOMER' WHEN coalesce(watermark, 0) < happened THEN 'WATERMARK'
  WHEN NOT coalesce(lateness_ms = coalesce(watermark, 0) - happened, false) THEN 'LATENESS' END AS row_error FROM t
UNION ALL SELECT 'INVALID', {ANCHOR_MS}, source_topic, source_partition, source_offset, sha256(coalesce(event_id, '')), '', '', code, 0, 0, CASE
  WHEN NOT coalesce(trim(source_topic) <> '' AND source_partition >= 0 AND source_offset >= 0, false) THEN 'COORDINATES' END FROM (SELECT *, {_CODE} AS code FROM payments) WHERE code IS NOT NULL""")  # fmt: skip
def outcome_rows(spark, d):
    bad = _tagged(spark, d).where(F.col("error_code").isNotNull()).withColumn("payload", F.encode("event_id", "utf-8"))
    letters = validate.dead_letters(bad, observed_at=F.lit(ANCHOR_MS))
    return validate.late_outcomes(table(spark, d, "late_events")).unionByName(validate.invalid_outcomes(letters))


_FACTS = ("event_id", "transaction_id", "customer_id", "merchant_id", "amount_minor", "currency", "country", "device_id", "status", "event_time")
_AT = ("source_timestamp", "source_partition", "source_offset")


def _first_sql(key: str) -> str:
    return f"""SELECT {key}, source_partition, source_offset, copies, variants FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY source_timestamp, source_partition, source_offset) AS rn, count(*) OVER (PARTITION BY {key}) AS copies FROM payments WHERE {key} IS NOT NULL)
JOIN (SELECT {key} AS k, count(DISTINCT ({', '.join(_FACTS)})) AS variants FROM payments GROUP BY 1) ON k = {key} WHERE rn = 1"""


def _firsts(spark, d, key):
    return identity_conflicts.first_of_each(table(spark, d, "payments").select(*_FACTS, *_AT), key, _AT)


@query(_first_sql("event_id"))
def dedup_event(spark, d):
    return _firsts(spark, d, "event_id").select("event_id", "source_partition", "source_offset", "copies", "variants")


@query(_first_sql("transaction_id"))
def dedup_txn(spark, d):
    return _firsts(spark, d, "transaction_id").select("transaction_id", "source_partition", "source_offset", "copies", "variants")


@query("""SELECT device_id, count(*) AS copies, count(DISTINCT (customer_id, device_id)) AS variants FROM payments WHERE device_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (customer_id, device_id)) > 1""")
def identity_conflicts_of_devices(spark, d):
    p = table(spark, d, "payments").select("customer_id", "device_id", *_AT)
    return identity_conflicts.conflicts(identity_conflicts.first_of_each(p, "device_id", _AT), "device_id")


@query("""SELECT source_topic, source_partition, source_offset, customer_id IS NULL AS key_is_null, event_id IS NULL AS value_is_null, coalesce(base64(encode(customer_id)), '') AS key_base64, coalesce(base64(encode(event_id)), '') AS payload_base64,
  CAST(coalesce(strlen(event_id), 0) AS BIGINT) AS payload_bytes, sha256(coalesce(event_id, '')) AS payload_sha256,
  '[{"key":"writer","is_null":' || CASE WHEN status IS NULL THEN 'true' ELSE 'false' END || ',"value_base64":"' || coalesce(base64(encode(status)), '') || '"}]' AS headers_json FROM payments""")  # fmt: skip
def archive_rows(spark, d):
    wire = table(spark, d, "payments").select("source_topic", "source_partition", "source_offset", "source_timestamp", F.lit("CreateTime").alias("timestamp_type"), F.encode("customer_id", "utf-8").alias("key"), F.encode("event_id", "utf-8").alias("payload"), F.array(F.struct(F.lit("writer").alias("key"), F.encode("status", "utf-8").alias("value"))).alias("headers"))
    return validate.archive_rows(wire).drop("source_timestamp", "timestamp_type")


@query("""WITH a AS (
  SELECT *, coalesce(event_time > 0 AND event_time <= producer_time + 300000, false) AS usable,
    max(CASE WHEN event_time > 0 AND event_time <= producer_time + 300000 THEN event_time END) OVER (PARTITION BY source_partition ORDER BY source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM payments)
SELECT source_partition, CASE WHEN NOT usable THEN 'INVALID' WHEN event_time <= frontier - 10001 THEN 'LATE' ELSE 'ADMITTED' END AS outcome, count(*) AS n FROM a GROUP BY 1, 2""")  # fmt: skip
def late_routing_batch(spark, d):
    a = late_periods.admit(table(spark, d, "payments"), cutoff_ms=DISORDER_MS)
    outcome = F.when(~F.col("usable"), "INVALID").when(F.col("refused"), "LATE").otherwise("ADMITTED")
    return a.groupBy("source_partition", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source_topic, source_partition, "after", "before" FROM (
  SELECT source_topic, source_partition, lag(source_offset) OVER (PARTITION BY source_topic, source_partition ORDER BY source_offset) AS "after", source_offset AS "before" FROM payments) WHERE "before" > "after" + 1""")
def offset_gaps(spark, d):
    return reconcile.offset_gaps(table(spark, d, "payments"))


@query("""WITH b AS (
  SELECT source_topic, source_partition, source_offset // 65536 AS b, sha256(string_agg(CAST(source_offset AS VARCHAR), chr(10) ORDER BY source_offset)) AS h, count(*) AS n, min(source_offset) AS lo, max(source_offset) AS hi FROM payments GROUP BY 1, 2, 3)
SELECT source_topic, source_partition, CAST(sum(n) AS BIGINT) AS records, CAST(0 AS BIGINT) AS repeated, 'WHOLE' AS state, min(lo) AS first, max(hi) AS last, sha256(sha256(sha256(string_agg(h, chr(10) ORDER BY b)))) AS digest FROM b GROUP BY 1, 2""")  # fmt: skip
def source_position_digest(spark, d):
    return reconcile.position_digest(table(spark, d, "payments"))


@query("SELECT source_topic, source_partition, max(source_offset) AS max_offset FROM evaluations GROUP BY 1, 2")
def source_offsets(spark, d):
    return reconcile.source_offsets(table(spark, d, "evaluations"))


# --- reconciliation -----------------------------------------------------------------------
_STATES = f"""WITH i AS (SELECT DISTINCT event_id FROM payments WHERE event_id IS NOT NULL),
e AS (SELECT DISTINCT event_id FROM evaluations), v AS (SELECT DISTINCT event_id FROM (SELECT *, {_CODE} AS code FROM payments) WHERE code IS NOT NULL),
l AS (SELECT DISTINCT json_extract_string(transaction, '$.event_id') AS event_id FROM late_events WHERE json_valid(transaction)),
s AS (SELECT event_id, (event_id IN (FROM e WHERE event_id IS NOT NULL)) AS ev, (event_id IN (FROM v WHERE event_id IS NOT NULL)) AS inv, (event_id IN (FROM l WHERE event_id IS NOT NULL)) AS la FROM i),
states AS (SELECT event_id, CASE WHEN ev::INT + inv::INT + la::INT > 1 THEN 'CONTRADICTED' WHEN ev THEN 'EVALUATED' WHEN inv THEN 'INVALID' WHEN la THEN 'LATE' ELSE 'UNRESOLVED' END AS state FROM s)"""


def _states(spark, d):
    late = table(spark, d, "late_events").select(F.get_json_object("transaction", "$.event_id").alias("event_id"))
    return reconcile.outcomes(table(spark, d, "payments"), table(spark, d, "evaluations"), _tagged(spark, d).where(F.col("error_code").isNotNull()), late)


@query(f"{_STATES} SELECT count(*) AS inputs, " + ", ".join(f"count(*) FILTER (state = '{k}') AS {k.lower()}" for k in ("EVALUATED", "INVALID", "LATE", "UNRESOLVED", "CONTRADICTED")) + " FROM states")
def reconcile_inputs(spark, d):
    return reconcile.report(_states(spark, d))


@query(f"{_STATES} SELECT event_id FROM states WHERE state = 'UNRESOLVED'")
def unresolved_inputs(spark, d):
    return _states(spark, d).where("state = 'UNRESOLVED'").select("event_id")


@query(f"SELECT DISTINCT event_id FROM evaluations WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM (SELECT *, {_CODE} AS code FROM payments) WHERE event_id IS NOT NULL AND code IS NULL)")
def unexpected_outcomes(spark, d):
    """Evaluations of events that never came in as a valid payment."""
    return reconcile.unexpected(table(spark, d, "evaluations"), _tagged(spark, d).where(F.col("error_code").isNull()))


@query("""WITH p AS (SELECT event_id, min(amount_minor) AS a FROM payments WHERE event_id IS NOT NULL GROUP BY 1), e AS (SELECT event_id, min(amount_minor) AS a FROM evaluations WHERE event_id IS NOT NULL GROUP BY 1)
SELECT event_id, CASE WHEN e.event_id IS NULL THEN 'MISSING' WHEN p.event_id IS NULL THEN 'UNEXPECTED' ELSE 'DIFFERENT' END AS difference
FROM p FULL JOIN e USING (event_id) WHERE e.event_id IS NULL OR p.event_id IS NULL OR p.a IS DISTINCT FROM e.a""")  # fmt: skip
def amounts_compared(spark, d):
    per = lambda n: table(spark, d, n).where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("amount_minor").alias("a"))
    return reconcile.set_difference(per("payments"), per("evaluations"), "event_id", "a")


@query("""WITH v AS (SELECT greatest(0, processed_at - event_time) AS value FROM evaluations WHERE processed_at IS NOT NULL), r AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS count FROM v)
SELECT p, value, count FROM r, (SELECT unnest([0.5, 0.95, 0.99, 1.0])::DOUBLE AS p) WHERE rn = greatest(1, CAST(ceil(p * count) AS BIGINT))""")  # fmt: skip
def latency_percentiles(spark, d):
    e = table(spark, d, "evaluations").where(F.col("processed_at").isNotNull())
    return reconcile.nearest_rank(e.select(F.greatest(F.lit(0), F.col("processed_at") - F.col("event_time")).alias("ms")), "ms")


# --- deliveries of results ------------------------------------------------------------------
_CONTENT = f"({', '.join(store.CONTENT)})"
_FIRST = "ORDER BY processed_at NULLS LAST, source_topic, source_partition, source_offset"
_CONFLICTS = f"conflicts AS (SELECT evaluation_id FROM evaluations WHERE evaluation_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_CONTENT}) > 1)"
_INTEGRITY = f"""{_CONFLICTS}, integrity AS (
  SELECT transaction_id, count(DISTINCT evaluation_id) AS evaluations, 1 + max(CASE WHEN evaluation_id IN (FROM conflicts) THEN 1 ELSE 0 END) AS content_variants
  FROM evaluations WHERE evaluation_id IS NOT NULL GROUP BY 1)"""
_SUMMARY = f"""{_INTEGRITY}, summary AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, event_time, evaluation_id {_FIRST}) AS rn FROM evaluations
    WHERE evaluation_id IS NOT NULL AND transaction_id NOT IN (SELECT transaction_id FROM integrity WHERE evaluations > 1 OR content_variants > 1)) WHERE rn = 1)"""


def _evals(spark, d):
    return table(spark, d, "evaluations")


def _summary(spark, d):
    return store.decisions_summary(_evals(spark, d))


@query(f"""SELECT evaluation_id, event_id, processed_at, source_partition, source_offset, delivery_count, content_variants FROM (
  SELECT *, row_number() OVER (PARTITION BY evaluation_id {_FIRST}) AS rn, count(*) OVER (PARTITION BY evaluation_id) AS delivery_count FROM evaluations WHERE evaluation_id IS NOT NULL)
JOIN (SELECT evaluation_id AS k, count(DISTINCT {_CONTENT}) AS content_variants FROM evaluations GROUP BY 1) ON k = evaluation_id WHERE rn = 1""")  # fmt: skip
def evaluations_logical(spark, d):
    return store.evaluations_logical(_evals(spark, d), "event_id", "processed_at", "source_partition", "source_offset")


@query(f"WITH {_CONFLICTS} SELECT evaluation_id FROM conflicts")
def evaluation_conflicts(spark, d):
    return store.evaluation_conflicts(_evals(spark, d))


@query(f"WITH {_INTEGRITY} SELECT * FROM integrity")
def transaction_integrity(spark, d):
    return store.transaction_integrity(_evals(spark, d))


@query(f"WITH {_INTEGRITY} SELECT * FROM integrity WHERE evaluations > 1 OR content_variants > 1")
def integrity_conflicts(spark, d):
    return store.integrity_conflicts(_evals(spark, d))


@query(f"WITH {_SUMMARY} SELECT evaluation_id, event_id, customer_id, event_time, transaction_id, amount_minor, decision, processed_at, source_offset, policy_version, md5(policy_snapshot) AS snapshot, md5(rule_evidence) AS evidence FROM summary")
def decisions_current(spark, d):
    c = store.decisions_current(_evals(spark, d))
    return c.select("evaluation_id", "event_id", "customer_id", "event_time", "transaction_id", "amount_minor", "decision", "processed_at", "source_offset", "policy_version", F.md5("policy_snapshot").alias("snapshot"), F.md5("rule_evidence").alias("evidence"))


@query(f"WITH {_SUMMARY} SELECT evaluation_id, customer_id, event_time, transaction_id, event_id, amount_minor, risk_score, decision, array_to_string(matched_rules, ',') AS matched_rules, processed_at FROM summary")
def decisions_summary(spark, d):
    return _summary(spark, d).select("evaluation_id", "customer_id", "event_time", "transaction_id", "event_id", "amount_minor", "risk_score", "decision", F.array_join("matched_rules", ",").alias("matched_rules"), "processed_at")


@query("""SELECT transaction_id, source_offset, decision, evaluation_id FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY source_offset DESC, decision DESC NULLS LAST, evaluation_id DESC NULLS LAST) AS rn FROM evaluations WHERE transaction_id IS NOT NULL) WHERE rn = 1""")
def latest_wins_decisions(spark, d):
    return store.latest_wins(_evals(spark, d).where(F.col("transaction_id").isNotNull()), "transaction_id", "source_offset", "source_offset", "decision", "evaluation_id")


@query("""SELECT source_topic, source_partition, source_offset, observed_at, customer_id, lateness_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY source_topic, source_partition, source_offset ORDER BY observed_at DESC, customer_id DESC NULLS LAST, lateness_ms DESC NULLS LAST) AS rn FROM (
    SELECT 'payments.late' AS source_topic, CAST(observed_at % 3 AS INTEGER) AS source_partition, observed_at // 3600000 AS source_offset, observed_at, customer_id, lateness_ms FROM late_events WHERE observed_at IS NOT NULL)) WHERE rn = 1""")
def rejections_latest(spark, d):
    r = table(spark, d, "late_events").where(F.col("observed_at").isNotNull()).select(F.lit("payments.late").alias("source_topic"), (F.col("observed_at") % 3).cast("int").alias("source_partition"), F.expr("observed_at div 3600000").alias("source_offset"), "observed_at", "customer_id", "lateness_ms")
    return store.rejections_latest(r)


_STORED_ID = "CASE WHEN coalesce(evaluation_id, '') = '' THEN 'eval_' || sha256('[\"' || event_id || '\",\"legacy\",\"dynamic\",0]') ELSE evaluation_id END"


@query(f"""SELECT source_partition, source_offset, {_STORED_ID} AS stored_id, CASE
  WHEN coalesce(trim(decision_id), '') = '' OR coalesce(trim(event_id), '') = '' OR coalesce(trim(transaction_id), '') = '' OR coalesce(trim(customer_id), '') = '' OR greatest(length(decision_id), length(event_id), length(transaction_id), length(customer_id)) > 256 THEN 'NAMES'
  WHEN NOT coalesce(risk_score BETWEEN 0 AND 100, false) THEN 'SCORE' WHEN NOT coalesce(decision IN ('APPROVE', 'REVIEW', 'REJECT'), false) THEN 'DECISION' WHEN NOT coalesce(currency = 'EUR', false) THEN 'CURRENCY'
  WHEN NOT coalesce(amount_minor BETWEEN 1 AND 1000000000000, false) THEN 'AMOUNT' WHEN NOT coalesce(policy_version >= 0, false) THEN 'POLICY_VERSION' WHEN NOT coalesce(event_time > 0, false) THEN 'EVENT_TIME' WHEN NOT coalesce(processed_at > 0, false) THEN 'PROCESSED_AT'
  WHEN coalesce(evaluation_id, '') <> '' AND NOT coalesce(evaluation_id = 'eval_' || sha256('["' || event_id || '","' || engine_version || '","' || policy_id || '",' || policy_version || ']'), false) THEN 'IDENTITY' END AS row_error FROM evaluations""")  # fmt: skip
def storable_rows(spark, d):
    return store.storable(_evals(spark, d)).select("source_partition", "source_offset", "stored_id", "row_error")


# --- reads -------------------------------------------------------------------------------------
# the shorter windows end where even the smallest tables have rows after their beginning
ANCHORS = {"15m": 1_748_390_400_000, "1h": 1_748_476_800_000, "24h": ANCHOR_MS}


def _window_queries(window: str) -> None:
    anchor = ANCHORS[window]
    b, where = overview.bucket_ms(window), f"processed_at >= {anchor - overview.WINDOWS[window] * 1000}"
    counts = "count(*) FILTER (decision = 'APPROVE') AS approved, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'REJECT') AS rejected"
    QUERIES[f"overview_totals_{window}"] = lambda s, d: overview.totals(overview.within(_summary(s, d), anchor, window))
    SQL[f"overview_totals_{window}"] = f"WITH {_SUMMARY} SELECT count(*) AS transactions, CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS amount_minor, {counts}, CAST(coalesce(quantile_disc(greatest(0, processed_at - event_time), 0.95), 0) AS BIGINT) AS finalization_p95 FROM summary WHERE {where}"
    QUERIES[f"overview_series_{window}"] = lambda s, d: overview.series(overview.within(_summary(s, d), anchor, window), window)
    SQL[f"overview_series_{window}"] = f"WITH {_SUMMARY} SELECT processed_at // {b} * {b} AS time, {counts} FROM summary WHERE {where} GROUP BY 1"
    QUERIES[f"overview_series_gapfilled_{window}"] = lambda s, d: overview.series_filled(overview.within(_summary(s, d), anchor, window), window, anchor)
    last = anchor // b * b
    SQL[f"overview_series_gapfilled_{window}"] = f"""WITH {_SUMMARY}, s AS (SELECT processed_at // {b} * {b} AS time, {counts} FROM summary WHERE {where} GROUP BY 1)
SELECT time, coalesce(approved, 0) AS approved, coalesce(review, 0) AS review, coalesce(rejected, 0) AS rejected FROM (SELECT unnest(range({last - 30 * b}, {last + 1}, {b})) AS time) LEFT JOIN s USING (time)"""


for _w in overview.WINDOWS:
    _window_queries(_w)
_COUNTS = "count(*) AS payments, count(*) FILTER (decision <> 'APPROVE') AS alerts, max(risk_score) AS max_score, max(event_time) AS last_event, count(*) FILTER (decision = 'APPROVE') AS approved, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'REJECT') AS rejected"


@query(f"WITH {_SUMMARY} SELECT id, count(*) AS matches FROM (SELECT unnest(matched_rules) AS id FROM summary) GROUP BY 1")
def rule_matches(spark, d):
    return overview.rule_matches(_summary(spark, d))


@query(f"WITH {_SUMMARY} SELECT transaction_id, customer_id, risk_score, processed_at FROM summary WHERE processed_at IS NOT NULL ORDER BY processed_at DESC, transaction_id LIMIT 100")
def latest_100(spark, d):
    return overview.latest(_summary(spark, d)).select("transaction_id", "customer_id", "risk_score", "processed_at")


@query(f"WITH {_SUMMARY} SELECT customer_id, {_COUNTS} FROM summary WHERE customer_id > 'cus-0000100' GROUP BY 1 ORDER BY 1 LIMIT 21")
def customers_page(spark, d):
    return overview.customers_page(_summary(spark, d), after="cus-0000100")


@query(f"WITH {_SUMMARY} SELECT customer_id, {_COUNTS} FROM summary WHERE starts_with(customer_id, 'cus-00000') GROUP BY 1 HAVING count(*) FILTER (decision = 'REVIEW') > 0 ORDER BY 1 LIMIT 21")
def customers_filtered(spark, d):
    return overview.customers_page(_summary(spark, d), prefix="cus-00000", decision="REVIEW")


@query(f"WITH {_SUMMARY} SELECT evaluation_id, event_time, transaction_id, decision, amount_minor FROM summary WHERE customer_id = 'cus-0000001' AND (event_time < 1747000000000 OR (event_time = 1747000000000 AND evaluation_id < 'eval_8')) ORDER BY event_time DESC, evaluation_id DESC LIMIT 21")
def timeline_page(spark, d):
    return overview.timeline_page(store.decisions_of(_evals(spark, d), "cus-0000001"), "cus-0000001", (1_747_000_000_000, "eval_8")).select("evaluation_id", "event_time", "transaction_id", "decision", "amount_minor")


@query(f"WITH {_SUMMARY} SELECT customer_id, {_COUNTS} FROM summary GROUP BY 1")
def serving_customers(spark, d):
    return overview.customers(_summary(spark, d))


@query(f"WITH {_SUMMARY} SELECT count(*) FILTER (decision = 'APPROVE') * 100.0 / nullif(count(*), 0) AS approval_percent, count(*) FILTER (decision IN ('REVIEW', 'REJECT')) AS flagged FROM summary")
def approval_share(spark, d):
    return overview.shares(_summary(spark, d))


@query(f"WITH {_SUMMARY} SELECT evaluation_id FROM summary WHERE contains(lower(concat_ws(' ', transaction_id, event_id, customer_id, array_to_string(matched_rules, ' '))), 'r004')")
def search_decisions(spark, d):
    return overview.search(_summary(spark, d), "R004").select("evaluation_id")


@query(f"WITH {_SUMMARY} SELECT decision, count(*) * 60.0 / 86400 AS per_minute FROM summary WHERE processed_at BETWEEN {ANCHOR_MS - 86_400_000 + 1} AND {ANCHOR_MS} GROUP BY 1")
def decisions_per_minute(spark, d):
    return overview.decisions_per_minute(_summary(spark, d), ANCHOR_MS, 86_400)


# --- rules ---------------------------------------------------------------------------------------
@query("SELECT policy_id, rule_id, version, policy_version, score, threshold, source_offset FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, rule_id ORDER BY version DESC, source_offset) AS rn FROM risk_rules) WHERE rn = 1")
def rule_updates_latest(spark, d):
    return policy.latest_rules(table(spark, d, "risk_rules")).select("policy_id", "rule_id", "version", "policy_version", "score", "threshold", "source_offset")


_KNOWN = ", ".join(f"'{t}'" for t in ("TX_COUNT_VELOCITY", "AMOUNT_VELOCITY", "UNIQUE_DEVICES", "NEW_DEVICE_HIGH_AMOUNT", "DECLINE_THEN_APPROVAL"))


@query(f"""SELECT source_offset, error_code FROM (SELECT source_offset, CASE
  WHEN version IS NULL OR score IS NULL OR window_seconds IS NULL OR threshold IS NULL OR updated_at IS NULL THEN 'INVALID_RULE_CONFIGURATION' WHEN NOT coalesce(type IN ({_KNOWN}), false) THEN 'UNKNOWN_RULE_TYPE'
  WHEN NOT coalesce(regexp_full_match(rule_id, 'R00[1-5]') AND version >= 1 AND score BETWEEN 0 AND 100 AND window_seconds BETWEEN 1 AND CASE WHEN type = 'NEW_DEVICE_HIGH_AMOUNT' THEN 2592000 ELSE 3600 END
    AND threshold >= 0 AND enabled IS NOT NULL AND currency = 'EUR' AND updated_at >= 0, false) THEN 'INVALID_RULE_CONFIGURATION' END AS error_code FROM risk_rules) WHERE error_code IS NOT NULL""")  # fmt: skip
def rules_invalid(spark, d):
    r = table(spark, d, "risk_rules").withColumn("error_code", policy.rule_error_column())
    return r.where(F.col("error_code").isNotNull()).select("source_offset", "error_code")


@query("""WITH e AS (SELECT event_id, min(policy_id) AS policy_id FROM evaluations WHERE policy_id <> 'dynamic' GROUP BY 1), p AS (SELECT event_id, min(source_timestamp) AS at FROM payments WHERE event_id IS NOT NULL GROUP BY 1)
SELECT p.event_id, r.policy_id, r.rule_id, max(r.version) AS version FROM p JOIN e USING (event_id) JOIN risk_rules r ON r.policy_id = e.policy_id AND greatest(r.updated_at, r.source_timestamp) <= p.at GROUP BY 1, 2, 3""")  # fmt: skip
def policy_asof_admission(spark, d):
    """The rule versions in force when a payment came in, of the policy it was scored by."""
    rects = materialize(bitemporal.version_rectangles(table(spark, d, "risk_rules"), ["policy_id", "rule_id"], "version", F.col("updated_at"), F.col("source_timestamp")), "rectangles")
    of = _evals(spark, d).where("policy_id <> 'dynamic'").groupBy("event_id").agg(F.min("policy_id").alias("policy_id"))
    p = table(spark, d, "payments").where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("source_timestamp").alias("at")).join(of, "event_id")
    return bitemporal.locate(p, rects, ["policy_id"], "at", "at").select("event_id", "policy_id", "rule_id", "version")


# --- reports over both sides --------------------------------------------------------------------
@query("""WITH s AS (SELECT event_id, min(producer_time) AS sent, min(source_timestamp) AS ack FROM payments WHERE event_id IS NOT NULL GROUP BY 1), d AS (SELECT event_id, min(processed_at) AS done, min(epoch_ms(ingested_at)) AS stored FROM evaluations WHERE event_id IS NOT NULL GROUP BY 1),
l AS (SELECT unnest(['producer_to_source', 'producer_to_result', 'result_to_storage', 'producer_to_storage']) AS leg, unnest([ack - sent, done - sent, stored - done, stored - sent]) AS ms FROM s JOIN d USING (event_id)),
r AS (SELECT leg, ms, row_number() OVER (PARTITION BY leg ORDER BY ms) AS rn, count(*) OVER (PARTITION BY leg) AS count FROM l WHERE ms IS NOT NULL)
SELECT leg, p, ms AS value, count FROM r, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE rn = greatest(1, CAST(ceil(p * count) AS BIGINT))""")  # fmt: skip
def latency_legs(spark, d):
    return reconcile.leg_report(table(spark, d, "payments"), _evals(spark, d))


@query(f"WITH {_SUMMARY}, c AS (SELECT customer_id, count(*) AS payments FROM summary WHERE customer_id IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(payments) OVER (ORDER BY customer_id) AS s FROM c) SELECT customer_id, payments FROM r WHERE s <= 1000")
def export_customers(spark, d):
    return reconcile.whole_customers(overview.customers(_summary(spark, d)).where(F.col("customer_id").isNotNull()))


_EXPORT = f"""WITH {_SUMMARY}, c AS (SELECT customer_id, count(*) AS payments FROM summary WHERE customer_id IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(payments) OVER (ORDER BY customer_id) AS s FROM c)"""


@query(f"{_EXPORT} SELECT sha256(policy_snapshot) AS policy_hash, count(*) AS decisions FROM summary WHERE customer_id IN (SELECT customer_id FROM r WHERE s <= 1000) AND policy_snapshot <> '' GROUP BY 1")
def export_policies(spark, d):
    return reconcile.export(store.decisions_current(_evals(spark, d)))[1].select("policy_hash", "decisions")


@query(f"""WITH {_INTEGRITY}, j AS (SELECT count(*) AS n FROM (SELECT DISTINCT observed_at FROM late_events WHERE observed_at IS NOT NULL))
SELECT (SELECT count(*) FROM integrity WHERE evaluations > 1 OR content_variants > 1) + (SELECT n FROM j) AS unresolved, (SELECT count(*) FROM integrity WHERE evaluations > 1 OR content_variants > 1) AS conflicts, (SELECT n FROM j) AS rejections""")  # fmt: skip
def integrity_gate(spark, d):
    rejected = table(spark, d, "late_events").where(F.col("observed_at").isNotNull()).select(F.lit("payments.late").alias("source_topic"), F.lit(0).alias("source_partition"), F.col("observed_at").alias("source_offset"), "observed_at")
    return reconcile.gate(store.integrity_conflicts(_evals(spark, d)), store.rejections_latest(rejected))

"""Queries of the general problems (p1..p4, p6, p7) over the tables of a directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import bitemporal, delivery, late_periods, nested, sessions, trailing
from ledgerlens.sources.tables import table

LAST_DAY = 20_237  # 2025-05-29, the last day of the data


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.other_version_than_implied(table(spark, d, "evaluations"), table(spark, d, "risk_rules"))


def p1_rules_at_event_time(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.rules_at_event_time(table(spark, d, "evaluations"), table(spark, d, "risk_rules"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late_periods.refused_deliveries(table(spark, d, "payments"))


def p2_hourly(spark: SparkSession, d: str) -> DataFrame:
    return late_periods.hourly(table(spark, d, "payments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.Flat(table(spark, d, "evaluations")).contributors()


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.Flat(table(spark, d, "evaluations")).typed("entry")


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    return nested.Flat(table(spark, d, "evaluations")).typed("rule")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return trailing.concentrated_idle_days(table(spark, d, "payments"), LAST_DAY)


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.customer_days(table(spark, d, "payments"), LAST_DAY)
    return t.select(F.col("entity").alias("customer_id"), "day", "total_7", "n_7", "total_30", "n_30", F.round("avg_7", 4).alias("avg_7"), F.round("avg_30", 4).alias("avg_30"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.repeated(table(spark, d, "evaluations"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    return delivery.one_of_each(table(spark, d, "evaluations")).select("evaluation_id", "source_partition", "source_offset", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.device_sessions(table(spark, d, "payments")).where(F.col("n") >= 5).select("customer_id", "device_id", "started_at", "ended_at")


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.device_sessions(table(spark, d, "payments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in sorted(globals().items()) if k.startswith("p") and k[1:2].isdigit()}

_KEPT = """kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY ingested_at, source_partition, source_offset) AS rn,
           count(*) OVER (PARTITION BY evaluation_id) AS copies
    FROM evaluations WHERE evaluation_id <> '') WHERE rn = 1)"""
_RULES = f"""WITH {_KEPT}, pairs AS (
  SELECT k.evaluation_id, r.rule_id,
         max(CASE WHEN greatest(r.updated_at, r.source_timestamp) <= k.event_time THEN r.version END) AS version,
         max(CASE WHEN r.policy_version <= k.policy_version THEN r.version END) AS implied
  FROM kept k JOIN risk_rules r ON r.policy_id = k.policy_id GROUP BY 1, 2)"""
def _json(text: str) -> str:
    """A JSON text as JSON, unwrapped once from a JSON string; null if unreadable."""
    one = f"CASE WHEN json_valid({text}) THEN CASE WHEN json_type({text}) = 'VARCHAR' THEN {text}::JSON ->> '$' ELSE {text} END END"
    return f"(SELECT CASE WHEN json_valid(t) THEN t::JSON END FROM (SELECT {one} AS t))"


_NESTED = f"""WITH docs AS (
  SELECT row_number() OVER () AS rid, evaluation_id, {_json('policy_snapshot')} AS s, {_json('rule_evidence')} AS e FROM evaluations WHERE evaluation_id <> ''),
sides AS (
  SELECT rid, coalesce(s -> '$.rules', s -> '$.policy.rules') AS r, coalesce(e -> '$.evidence', e) AS e FROM docs WHERE s IS NOT NULL AND e IS NOT NULL),
rules AS (
  SELECT rid, x ->> '$.rule_id' AS rule_id, CAST(x ->> '$.version' AS BIGINT) AS version FROM (SELECT rid, unnest(json_extract(r, '$[*]')) AS x FROM sides WHERE json_type(r) = 'ARRAY')
  UNION SELECT rid, k, CAST(json_extract_string(r, '$.' || k || '.version') AS BIGINT) FROM (SELECT rid, r, unnest(json_keys(r)) AS k FROM sides WHERE json_type(r) = 'OBJECT')),
entries AS (
  SELECT rid, x ->> '$.rule_id' AS rule_id, x FROM (SELECT rid, unnest(json_extract(e, '$[*]')) AS x FROM sides WHERE json_type(e) = 'ARRAY')
  UNION ALL SELECT rid, k, json_extract(e, '$.' || k) FROM (SELECT rid, e, unnest(json_keys(e)) AS k FROM sides WHERE json_type(e) = 'OBJECT')),
listed AS (
  SELECT rid, rule_id, CAST(x ->> '$.rule_version' AS BIGINT) AS rule_version, unnest([x -> '$.contributors', x -> '$.lookback.contributors']) AS c FROM entries),
members AS (
  SELECT rid, rule_id, rule_version, unnest(json_extract(c, '$[*]')) AS c FROM listed WHERE json_type(c) = 'ARRAY'
  UNION ALL SELECT rid, rule_id, rule_version, c FROM listed WHERE json_type(c) = 'OBJECT'),
named AS (
  SELECT rid, rule_id, rule_version, CASE json_type(c) WHEN 'VARCHAR' THEN c ->> '$' WHEN 'OBJECT' THEN coalesce(c ->> '$.event_id', c ->> '$.payment.event_id') END AS event_id FROM members)"""
_BRIDGED = f"""WITH docs AS (
  SELECT evaluation_id, source_partition, source_offset, {_json('policy_snapshot')} AS s, {_json('rule_evidence')} AS e FROM evaluations),
rules AS (SELECT *, coalesce(s -> '$.rules', s -> '$.policy.rules') AS r FROM docs WHERE s IS NOT NULL),
entries AS (SELECT *, coalesce(e -> '$.evidence', e) AS r, (e -> '$.evidence') IS NOT NULL AS named FROM docs WHERE e IS NOT NULL)"""
_AT = "evaluation_id, source_partition, source_offset"
_USABLE = "(event_time > 0 AND event_time <= producer_time + 300000)"
_ADMIT = f"""admitted AS (
  SELECT *, coalesce({_USABLE}, false) AS usable,
         max(CASE WHEN {_USABLE} THEN event_time END) OVER (PARTITION BY source_partition ORDER BY source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier
  FROM payments)"""
_COUNTED = f"""counted AS (
  SELECT event_id, any_value(customer_id) AS customer_id, any_value(device_id) AS device_id, any_value(event_time) AS event_time,
         any_value(amount_minor) AS amount_minor, any_value(currency) AS currency
  FROM payments WHERE {_USABLE} AND trim(customer_id) <> '' GROUP BY event_id)"""
_TRAILING = f"""WITH {_COUNTED}, daily AS (
  SELECT customer_id, event_time // 86400000 AS day, sum(amount_minor) AS total, count(*) AS n
  FROM counted WHERE currency = 'EUR' AND amount_minor BETWEEN 1 AND 1000000000000 GROUP BY 1, 2),
dates AS (
  SELECT customer_id, first_day, unnest(range(first_day, {LAST_DAY + 1})) AS day
  FROM (SELECT customer_id, min(day) AS first_day FROM daily GROUP BY 1)),
filled AS (
  SELECT customer_id, first_day, day, daily.n IS NOT NULL AS active, coalesce(total, 0) AS total, coalesce(n, 0) AS n
  FROM dates LEFT JOIN daily USING (customer_id, day)),
windowed AS (
  SELECT *, CAST(sum(total) OVER w7 AS BIGINT) AS total_7, CAST(sum(n) OVER w7 AS BIGINT) AS n_7,
         CAST(sum(total) OVER w30 AS BIGINT) AS total_30, CAST(sum(n) OVER w30 AS BIGINT) AS n_30
  FROM filled WINDOW w7 AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                     w30 AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_SESSIONS = f"""WITH {_COUNTED}, marked AS (
  SELECT *, CASE WHEN event_time - lag(event_time) OVER w <= 1800000 THEN 0 ELSE 1 END AS opens
  FROM counted WHERE device_id IS NOT NULL WINDOW w AS (PARTITION BY customer_id, device_id ORDER BY event_time)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY customer_id, device_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (
  SELECT customer_id, device_id, min(event_time) AS started_at, max(event_time) AS ended_at, count(*) AS n
  FROM numbered GROUP BY customer_id, device_id, s)"""

SQL: dict[str, str] = {
    "p1_found": f"{_RULES} SELECT evaluation_id, rule_id, version FROM pairs WHERE version IS NOT NULL AND version IS DISTINCT FROM implied",
    "p1_rules_at_event_time": f"{_RULES} SELECT evaluation_id, rule_id, version, implied FROM pairs WHERE version IS NOT NULL",
    "p2_found": f"WITH {_ADMIT} SELECT source_partition, source_offset FROM admitted WHERE usable AND event_time <= frontier - 7200000",
    "p2_hourly": f"""WITH {_ADMIT}, firsts AS (
  SELECT event_id, any_value(event_time) AS event_time, any_value(CASE WHEN amount_minor BETWEEN 1 AND 1000000000000 THEN amount_minor END) AS amount
  FROM admitted WHERE usable AND NOT coalesce(event_time <= frontier - 7200000, false) AND trim(customer_id) <> '' GROUP BY event_id)
SELECT event_time - event_time % 3600000 AS period_start, count(*) AS n, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount_minor FROM firsts GROUP BY 1""",
    "p3_found": f"{_NESTED} SELECT DISTINCT evaluation_id, rule_id, rule_version, event_id FROM named JOIN docs USING (rid) JOIN rules r USING (rid, rule_id) WHERE r.version = rule_version AND event_id <> ''",
    "p3_entries": f"""{_BRIDGED}
SELECT {_AT}, CASE WHEN named THEN 'evidence' ELSE '' END AS name, CAST(i - 1 AS INTEGER) AS position, json_extract_string(x, '$.rule_id') AS rule_id, CAST(json_extract_string(x, '$.rule_version') AS BIGINT) AS rule_version
FROM (SELECT *, unnest(json_extract(r, '$[*]')) AS x, generate_subscripts(json_extract(r, '$[*]'), 1) AS i FROM entries WHERE json_type(r) = 'ARRAY')
UNION ALL SELECT {_AT}, k, 0, k, CAST(json_extract_string(r, '$.' || k || '.rule_version') AS BIGINT) FROM (SELECT *, unnest(json_keys(r)) AS k FROM entries WHERE json_type(r) = 'OBJECT')""",
    "p3_rules": f"""{_BRIDGED}
SELECT {_AT}, 'rules' AS name, CAST(i - 1 AS INTEGER) AS position, json_extract_string(x, '$.rule_id') AS rule_id, CAST(json_extract_string(x, '$.version') AS BIGINT) AS rule_version
FROM (SELECT *, unnest(json_extract(r, '$[*]')) AS x, generate_subscripts(json_extract(r, '$[*]'), 1) AS i FROM rules WHERE json_type(r) = 'ARRAY')
UNION ALL SELECT {_AT}, k, 0, k, CAST(json_extract_string(r, '$.' || k || '.version') AS BIGINT) FROM (SELECT *, unnest(json_keys(r)) AS k FROM rules WHERE json_type(r) = 'OBJECT')""",
    "p4_found": f"{_TRAILING} SELECT customer_id, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day FROM windowed WHERE NOT active AND day >= first_day + 29 AND total_30 > 0 AND total_7 * 30 >= 21 * total_30",
    "p4_trailing": f"{_TRAILING} SELECT customer_id, CAST(day AS INTEGER) AS day, total_7, n_7, total_30, n_30, round(total_7 / 7, 4) AS avg_7, round(total_30 / 30, 4) AS avg_30 FROM windowed",
    "p6_found": f"WITH {_KEPT} SELECT evaluation_id, source_partition, source_offset FROM kept WHERE copies > 1",
    "p6_kept": f"WITH {_KEPT} SELECT evaluation_id, source_partition, source_offset, copies FROM kept",
    "p7_found": f"{_SESSIONS} SELECT customer_id, device_id, started_at, ended_at FROM sessions WHERE n >= 5",
    "p7_sessions": f"{_SESSIONS} SELECT customer_id, device_id, started_at, ended_at, ended_at - started_at AS duration_ms, n FROM sessions",
}

"""Queries over generated payments, stories, policies, identities and published generations, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import policy
from ledgerlens.operators import lookback, metrics, reconcile, store, validate
from ledgerlens.operators.score import score
from ledgerlens.plans import publish, reference
from ledgerlens.sources import avro, generator, schemas, streams
from ledgerlens.sources.tables import table
from ledgerlens.session import checkpoint_dir, delete, materialize, spread, stateful
from ledgerlens.streaming import periods, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PAYMENTS_A_TASK = 100_000  # of a stream


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT * FROM (VALUES ('everyday', 'LEGITIMATE', 0, '', 3), ('known-device-large', 'LEGITIMATE', 0, '', 2), ('new-phone', 'LEGITIMATE', 30, 'R004', 2),
  ('account-takeover', 'SUSPICIOUS', 100, 'R001,R002,R003,R004,R005', 7), ('card-testing', 'SUSPICIOUS', 40, 'R005', 6), ('multiple-devices', 'SUSPICIOUS', 85, 'R002,R003,R004', 4),
  ('small-payment-burst', 'SUSPICIOUS', 25, 'R001', 7), ('stolen-trusted-device', 'SUSPICIOUS', 0, '', 2), ('legitimate-retry', 'LEGITIMATE', 0, '', 3)) t(name, label, risk_score, matched_rules, payments)""")  # fmt: skip
def story_scores(spark, d):
    s = generator.stories(spark, None, reference.ANCHOR_MS)
    one = score(s.drop("label", "target"), reference.POLICY, F.col("event_time")).select("event_id", "risk_score", F.array_join("matched_rules", ",").alias("matched_rules"))
    per = s.groupBy("customer_id").agg(F.count(F.lit(1)).cast("int").alias("payments"))
    t = s.where("target").join(one, "event_id").join(per, "customer_id")
    return t.select(F.substring("customer_id", 6, 100).alias("name"), "label", "risk_score", "matched_rules", "payments")


@query("SELECT CAST(3 AS BIGINT) AS tp, CAST(1 AS BIGINT) AS fp, CAST(2 AS BIGINT) AS fn, CAST(3 AS BIGINT) AS tn, 3 / 4 AS precision, 3 / 5 AS recall, 1 / 4 AS false_positive_rate")
def story_confusion(spark, d):
    return reconcile.confusion(story_scores(spark, d))


@query("""SELECT * FROM (VALUES ('burst', 320, true, 0, 0, true), ('duplicates', 320, true, 0, 0, true), ('high-cardinality', 2000, true, 0, 0, true), ('hot-key', 320, true, 0, 0, true), ('late', 320, true, 1, 0, true),
  ('malformed', 320, true, 0, 1, true), ('out-of-order', 320, true, 0, 0, true), ('steady', 320, false, 0, 0, true)) t(scenario, payments, retried, late, malformed, placed)""")  # fmt: skip
def generated_loads(spark, d):
    """Per scenario: distinct payments, whether some come again, whether any is late or malformed, and whether coordinates are unique."""
    parts = []
    for name, c in generator.SCENARIOS.items():
        g = generator.payments(spark, c).withColumn("code", validate.error_code(F.col("producer_time")))
        n, ids = F.count(F.lit(1)), F.count_distinct("event_id")
        late = F.bool_or(F.col("producer_time") - F.col("event_time") > 7_200_000).cast("int")
        parts.append(g.agg(F.lit(name).alias("scenario"), ids.cast("int").alias("payments"), (n > ids).alias("retried"), late.alias("late"), F.bool_or(F.col("code").isNotNull()).cast("int").alias("malformed"), (n == F.count_distinct("source_partition", "source_offset")).alias("placed")))
    return reduce(DataFrame.unionByName, parts)


_RULE = '{{"currency":"EUR","enabled":true,"rule_id":"{0}","score":{4},"threshold":{5},"type":"{1}","updated_at":0,"version":1,"window_seconds":{3}}}'
_FIVE = [(r.rule_id, r.type, None, r.window_seconds, r.score, r.threshold) for r in reference.POLICY.rules]
_SNAPSHOT = '{"reject_threshold":70,"review_threshold":30,"rules":[' + ",".join(_RULE.format(*r) for r in _FIVE) + "]}"


@query(f"""SELECT 'default' AS policy_id, '{_SNAPSHOT}' AS snapshot, '44678769d6cf7aedd5f72c77a0e0d1b4f714b3445ff778a469decc87fc767a94' AS fingerprint""")
def policy_snapshot(spark, d):
    p = reference.POLICY
    return spark.createDataFrame([(p.policy_id, p.snapshot(), p.fingerprint())], "policy_id string, snapshot string, fingerprint string")


_VALID = "rule_id SIMILAR TO 'R00[1-5]' AND version >= 1 AND score BETWEEN 0 AND 100 AND window_seconds BETWEEN 1 AND CASE WHEN type = 'NEW_DEVICE_HIGH_AMOUNT' THEN 2592000 ELSE 3600 END AND threshold >= 0 AND enabled IS NOT NULL AND currency = 'EUR' AND updated_at >= 0 AND type IN ('TX_COUNT_VELOCITY', 'AMOUNT_VELOCITY', 'UNIQUE_DEVICES', 'NEW_DEVICE_HIGH_AMOUNT', 'DECLINE_THEN_APPROVAL')"


@query(f"""WITH log AS (SELECT *, coalesce({_VALID}, false) AS good FROM risk_rules), versions AS (SELECT DISTINCT policy_id, policy_version FROM log),
held AS (SELECT a.policy_id, a.policy_version, l.rule_id, l.good, row_number() OVER (PARTITION BY a.policy_id, a.policy_version, l.rule_id ORDER BY l.version DESC, l.good DESC) AS rn
  FROM versions a JOIN log l ON l.policy_id = a.policy_id AND l.policy_version <= a.policy_version)
SELECT policy_id, policy_version, count(*) AS rules, count(*) = 5 AND bool_and(good) AS complete FROM held WHERE rn = 1 GROUP BY 1, 2""")  # fmt: skip
def policy_catalogue(spark, d):
    return policy.releases(table(spark, d, "risk_rules"))


@query("SELECT source_partition, source_offset, 'eval_' || sha256('[\"' || event_id || '\",\"legacy\",\"dynamic\",0]') AS stored_id FROM evaluations WHERE coalesce(evaluation_id, '') = ''")
def legacy_ids(spark, d):
    e = table(spark, d, "evaluations").where(F.coalesce("evaluation_id", F.lit("")) == "")
    return store.storable(e).select("source_partition", "source_offset", "stored_id")


@query("SELECT source_topic, source_partition, max(source_offset) + 1 AS next_offset FROM payments GROUP BY 1, 2")
def acknowledged_offsets(spark, d):
    return reconcile.acknowledged(table(spark, d, "payments"))


@query(f"""SELECT p.source_partition, p.source_offset, p.event_id, code AS error_code FROM payments p JOIN (SELECT source_topic, source_partition, source_offset, {reference._CODE} AS code FROM payments) o
  USING (source_topic, source_partition, source_offset) WHERE code IS NOT NULL""")
def outcomes_by_coordinates(spark, d):
    p = table(spark, d, "payments")
    bad = validate.split_valid(p, validate.error_code(F.col("producer_time")))[1]
    return reconcile.by_coordinates(p.select("source_topic", "source_partition", "source_offset", "event_id"), bad, "error_code").select("source_partition", "source_offset", "event_id", "error_code")


@query(f"""SELECT DISTINCT event_id FROM payments p WHERE EXISTS (SELECT 1 FROM evaluations e WHERE e.event_id = p.event_id) AND EXISTS (SELECT 1 FROM (SELECT *, {reference._CODE} AS code FROM payments) v WHERE v.code IS NOT NULL AND v.event_id = p.event_id)""")
def contradicted_inputs(spark, d):
    p = table(spark, d, "payments")
    bad = validate.split_valid(p, validate.error_code(F.col("producer_time")))[1]
    return reconcile.evaluated_and_invalid(p, table(spark, d, "evaluations"), bad)


@query(f"""WITH p AS (SELECT *, {reference._CODE} AS code FROM payments) SELECT count(*) FILTER (code IS NULL) AS valid, count(*) FILTER (code IS NOT NULL) AS invalid, count(*) AS archived,
  (SELECT count(*) FROM late_events) AS late FROM p""")  # fmt: skip
def stored_outcomes(spark, d):
    """Counts of what a batch leaves in the tables of a store: valid payments, dead letters and late records, and the archive."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/store-{uuid.uuid4().hex}"
    p = table(spark, d, "payments")
    good, bad = validate.split_valid(p.withColumn("payload", F.encode("event_id", "utf-8")), validate.error_code(F.col("producer_time")))
    outcomes = validate.late_outcomes(table(spark, d, "late_events")).unionByName(validate.invalid_outcomes(validate.dead_letters(bad, observed_at=F.lit(reference.ANCHOR_MS))))
    store.append(p, root, "payment_ingress", 0)
    store.append(outcomes, root, "processing_outcomes", 0)
    kinds = spark.read.parquet(f"{root}/processing_outcomes").groupBy().agg(F.count_if(F.col("outcome") == "INVALID").alias("invalid"), F.count_if(F.col("outcome") == "LATE").alias("late"))
    counts = {"archived": spark.read.parquet(f"{root}/payment_ingress").count(), "valid": good.count(), **kinds.first().asDict()}
    return spark.createDataFrame([(counts["valid"], counts["invalid"], counts["archived"], counts["late"])], "valid bigint, invalid bigint, archived bigint, late bigint")


def generation(spark: SparkSession, d: str) -> tuple[str, publish.Publication]:
    """A published generation of all deliveries of transactions without conflict."""
    e = table(spark, d, "evaluations")
    clean = e.join(store.decisions_summary(e).select("evaluation_id"), "evaluation_id", "left_semi").select(*e.columns)
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/generations-{uuid.uuid4().hex}"
    return root, publish.publish(materialize(clean, "clean"), root, 1 << 62, recent=False)


@query(f"WITH {reference._SUMMARY} SELECT 'READY' AS status, count(*) AS assessments, (SELECT count(*) FROM evaluations WHERE evaluation_id IN (SELECT evaluation_id FROM summary)) AS deliveries, count(DISTINCT customer_id) AS customers FROM summary")
def published_generation(spark, d):
    root, p = generation(spark, d)
    customers = spark.read.parquet(f"{root}/customers/generation={p.generation}").count()
    return spark.createDataFrame([(p.status, p.assessments, p.deliveries, customers)], "status string, assessments bigint, deliveries bigint, customers bigint")


@query(f"WITH {reference._SUMMARY} SELECT customer_id, {reference._COUNTS} FROM summary GROUP BY 1")
def published_customers(spark, d):
    root, p = generation(spark, d)
    return publish.Reader(spark, root).table("customers", p.started_at)


@query("SELECT 'BLOCKED' AS status, count(*) AS assessments FROM (SELECT DISTINCT evaluation_id FROM evaluations WHERE evaluation_id IS NOT NULL)")
def blocked_generation(spark, d):
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/generations-{uuid.uuid4().hex}"
    p = publish.publish(table(spark, d, "evaluations"), root, 1 << 62)
    return spark.createDataFrame([(p.status, p.assessments)], "status string, assessments bigint")


@query(f"""WITH w AS (SELECT epoch_ms(archived_at) // 21600000 * 21600000 AS time, count(*) FILTER (code IS NOT NULL) AS value FROM (SELECT *, {reference._CODE} AS code FROM payments) WHERE archived_at IS NOT NULL GROUP BY 1)
SELECT time, CAST(value AS DOUBLE) AS value, coalesce(value > 1 AND (SELECT count(*) FROM w b WHERE b.time = w.time - 21600000 AND b.value > 1) = 1, false) AS raised FROM w""")  # fmt: skip
def invalid_input_alerts(spark, d):
    """More than one invalid delivery in a quarter of a day, and in the quarter before it."""
    p = table(spark, d, "payments").withColumn("invalid", validate.error_code(F.col("producer_time")).isNotNull()).withColumn("at", F.unix_millis(F.col("archived_at").cast("timestamp")))
    return metrics.raised(p, "at", "invalid", metrics.Alert("invalid_input", "invalid", 1, window_s=21_600, for_s=21_600))


def _hot_payments(spark: SparkSession, d: str) -> DataFrame:
    hot = F.when(F.col("customer_id").isin(*[f"cust-{i}" for i in range(0, 3_000, 3)]), "cust-hot").otherwise(F.col("customer_id"))
    return reference.card_payments(spark, d).withColumn("customer_id", hot)


_HOT = reference._CARD.replace("'cust-' || user_id AS customer_id", "CASE WHEN user_id % 3 = 0 AND user_id < 3000 THEN 'cust-hot' ELSE 'cust-' || user_id END AS customer_id")


@query(f"""WITH {_HOT}, w AS (SELECT event_id, count(*) OVER (PARTITION BY customer_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) - coalesce(count(*) OVER (PARTITION BY customer_id ORDER BY event_time RANGE BETWEEN UNBOUNDED PRECEDING AND 120000 PRECEDING), 0) AS payments,
  customer_id, device_id, event_time FROM card), pairs AS (SELECT customer_id, device_id, event_time, event_id, lead(event_time) OVER (PARTITION BY customer_id, device_id ORDER BY event_time, event_id) AS nt, lead(event_id) OVER (PARTITION BY customer_id, device_id ORDER BY event_time, event_id) AS ne FROM card)
SELECT w.event_id, w.payments, (SELECT count(*) FROM pairs p WHERE p.customer_id = w.customer_id AND p.event_time > w.event_time - 900000 AND (p.event_time, p.event_id) <= (w.event_time, w.event_id) AND (p.nt IS NULL OR (p.nt, p.ne) > (w.event_time, w.event_id))) AS devices FROM w""")  # fmt: skip
def hot_customer(spark, d):
    """A third of all payments under one customer: counts and devices in the windows before each."""
    seen = lookback.observations(_hot_payments(spark, d), [r for r in reference.POLICY.rules if r.type in ("TX_COUNT_VELOCITY", "UNIQUE_DEVICES")])
    return seen.select("event_id", F.col("o_R001").alias("payments"), F.col("o_R003").alias("devices"))


@query("SELECT source_topic, source_partition, source_offset FROM payments WHERE source_partition = 0 AND source_offset BETWEEN 100 AND 299 OR source_partition = 2 AND source_offset < 50")
def bounded_log(spark, d):
    ranges = {("payments.raw", 0): (100, 300), ("payments.raw", 2): (0, 50)}
    return streams.bounded(table(spark, d, "payments"), ranges).select("source_topic", "source_partition", "source_offset")


_FIELDS = ", ".join(schemas.TRANSACTION.names)


@query(f"SELECT source_partition, source_offset, {_FIELDS}, NULL::VARCHAR AS decode_error FROM payments WHERE {' AND '.join(f'{f} IS NOT NULL' for f in schemas.TRANSACTION.names)}")
def binary_records(spark, d):
    """Payments written as framed binary records and read again; those that lack a field cannot be written."""
    schema = avro.record("Transaction", schemas.TRANSACTION)
    p = table(spark, d, "payments")
    wire = p.select("source_partition", "source_offset", avro.encoded(F.struct(*schemas.TRANSACTION.names), schema, 7).alias("payload")).where(F.col("payload").isNotNull())
    return wire.select("source_partition", "source_offset", avro.decoded(F.col("payload"), {7: schema}, schemas.TRANSACTION).alias("r")).select("source_partition", "source_offset", "r.*")


@query(f"""WITH good AS (SELECT rule_id, version, type, enabled, score, window_seconds, threshold FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY version DESC, type DESC, enabled DESC, score DESC, window_seconds DESC, threshold DESC, currency DESC, updated_at DESC) AS rn
    FROM risk_rules WHERE policy_id = 'shop-eur-main' AND coalesce({_VALID}, false)) WHERE rn = 1 AND version > 1)
SELECT * FROM good UNION ALL SELECT * FROM (VALUES {', '.join(f"('{r.rule_id}', {r.version}, '{r.type}', true, {r.score}, {r.window_seconds}, {r.threshold})" for r in reference.POLICY.rules)}) b WHERE col0 NOT IN (SELECT rule_id FROM good)""")  # fmt: skip
def policy_in_force(spark, d):
    """The default rules with the updates of a control topic: strictly higher versions of valid rules."""
    p = policy.updated(reference.POLICY, table(spark, d, "risk_rules").where("policy_id = 'shop-eur-main'"))
    rows = [(r.rule_id, r.version, r.type, r.enabled, r.score, r.window_seconds, r.threshold) for r in p.rules]
    return spark.createDataFrame(rows, "rule_id string, version bigint, type string, enabled boolean, score int, window_seconds bigint, threshold bigint")


@query(f"{reference._SCORED} SELECT event_id, risk_score, decision, matched_rules FROM decided")
def stream_scores(spark, d):
    """The same payments through the stateful scorer: a stream over files, one of which moves the watermark past
    all others and past their windows, so that the batch after it finalises them and leaves no state."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/stream-{uuid.uuid4().hex}"
    spread(reference.card_payments(spark, d)).write.parquet(f"{root}/in")
    n, top = spark.read.schema(schemas.TRANSACTION).parquet(f"{root}/in").agg(F.count(F.lit(1)), F.max("event_time")).first()
    last = max(reference.ANCHOR_MS, (top or 0) + 2 * policy.DEVICE_S * 1000)
    end = ("end", "end", "nobody", "end", 1, "EUR", "IT", "end", "APPROVED", last, last)
    spark.createDataFrame([end], schemas.TRANSACTION).coalesce(1).write.mode("append").parquet(f"{root}/in")
    given = streams.file_stream(spark, f"{root}/in", schemas.TRANSACTION, max_files=1 << 30)
    out = scoring.score_stream(given, reference.POLICY, fields=("kind", "event_id", "risk_score", "decision", "matched_rules"))
    parts = spark.sparkContext.defaultParallelism + n // PAYMENTS_A_TASK
    with stateful(spark, **{"spark.sql.shuffle.partitions": str(parts), "spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
        periods.route(out, f"{root}/out", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for done in ("in", "checkpoint"):
        delete(spark, f"{root}/{done}")
    scored = spark.read.schema("event_id string, risk_score int, decision string, matched_rules array<string>, kind string").parquet(f"{root}/out").where("kind = 'DECISION'")
    return scored.select("event_id", "risk_score", "decision", F.array_join("matched_rules", ",").alias("matched_rules"))

"""Views over the deliveries of scoring results: logical rows, conflicts, current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import identity
from ledgerlens.session import if_small, materialize

CONTENT = (
    "decision_id", "event_id", "transaction_id", "customer_id", "amount_minor", "currency", "risk_score", "decision", "matched_rules", "reason_codes",
    "rules_fingerprint", "event_time", "engine_version", "policy_id", "policy_version", "policy_snapshot", "rule_evidence", "input_sha256",
)
ORDER = ("processed_at", "source_topic", "source_partition", "source_offset")
KEYS = ("customer_id", "event_time", "event_id")
WIDE = tuple(c for c in CONTENT if c not in ("event_id", "customer_id", "event_time")) + ORDER
NARROW = ("transaction_id", "event_id", "amount_minor", "risk_score", "decision", "matched_rules", "reason_codes", "rules_fingerprint", "processed_at", "source_partition", "source_offset")


def content_hash() -> Column:
    """What a delivery says, without where and when it was delivered, as 128 bits: wide texts (snapshot,
    evidence) are never exchanged as themselves, and only deliveries of one evaluation are held against
    each other. Which fields are null is hashed too, as the hash function passes over nulls."""
    fields = [F.to_json(c) if c in ("matched_rules", "reason_codes") else F.col(c) for c in CONTENT]
    nulls = F.lit(0)
    for i, c in enumerate(CONTENT):
        nulls = nulls + F.when(F.col(c).isNull(), 1 << i).otherwise(0)
    return F.struct(F.xxhash64(nulls, *fields), F.xxhash64(*reversed(fields), nulls))


def _identified(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("evaluation_id").isNotNull())


def _first() -> Column:
    return F.struct(*[x for c in ORDER for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])


def contents(deliveries: DataFrame, *columns: str) -> DataFrame:
    """(evaluation_id, transaction_id, _row, _order, _n): one row per evaluation and content, with the given
    columns of its first delivery and the number of deliveries; redeliveries are reduced before the
    exchange. All views are made of it, so that deliveries are read once."""
    keep = [c for c in columns if c not in ("evaluation_id", "transaction_id")] or ["source_offset"]
    rows = _identified(deliveries).select("evaluation_id", "transaction_id", F.struct(*keep).alias("_row"), _first().alias("_order"), content_hash().alias("_content"))
    one = rows.groupBy("evaluation_id", "transaction_id", "_content").agg(F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order"), F.count(F.lit(1)).alias("_n"))
    return one.drop("_content")


def evaluations_logical(deliveries: DataFrame, *columns: str) -> DataFrame:
    """(evaluation_id, columns of the canonical delivery..., delivery_count, content_variants). The
    canonical delivery has the least (processed_at, topic, partition, offset), nulls last."""
    keep = [c for c in columns if c != "evaluation_id"]
    # two steps: the number of contents is a count of groups, so no set of hashes grows in a task
    per = contents(deliveries, *keep).withColumn("_row", F.struct("transaction_id", "_row"))
    one = per.groupBy("evaluation_id").agg(F.min_by("_row", "_order").alias("_row"), F.sum("_n").alias("delivery_count"), F.count(F.lit(1)).alias("content_variants"))
    return one.select("evaluation_id", *[F.col("_row.transaction_id" if c == "transaction_id" else f"_row._row.{c}").alias(c) for c in keep], "delivery_count", "content_variants")


def _conflicts(of: DataFrame) -> DataFrame:
    return of.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("evaluation_id")


def evaluation_conflicts(deliveries: DataFrame) -> DataFrame:
    return _conflicts(contents(deliveries))


def transaction_integrity(deliveries: DataFrame) -> DataFrame:
    """(transaction_id, evaluations, content_variants): from the deliveries themselves, as a
    conflicting evaluation could hide another transaction."""
    stored = materialize(contents(deliveries).select("transaction_id", "evaluation_id"), "contents")
    bad = _conflicts(stored).withColumn("_bad", F.lit(1))
    joined = stored.distinct().join(bad, "evaluation_id", "left")
    return joined.groupBy("transaction_id").agg(F.count("evaluation_id").alias("evaluations"), (1 + F.max(F.coalesce("_bad", F.lit(0)))).alias("content_variants"))


def integrity_conflicts(deliveries: DataFrame) -> DataFrame:
    return transaction_integrity(deliveries).where((F.col("evaluations") > 1) | (F.col("content_variants") > 1))


def _unambiguous(stored: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """The rows of a written table of contents whose transaction has one evaluation with one content:
    that row is the evaluation's only one, so nothing is left to be reduced. foreign: transactions
    known to be ambiguous by other rows. Rows without a transaction are left out."""
    many = stored.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("transaction_id")
    torn = stored.select("evaluation_id", "transaction_id").join(_conflicts(stored), "evaluation_id", "left_semi").select("transaction_id")
    bad = many.unionByName(torn)
    if foreign is not None:
        bad = bad.unionByName(foreign)
    bad = materialize(bad.distinct(), "ambiguous")
    return stored.where(F.col("transaction_id").isNotNull()).join(if_small(bad), "transaction_id", "left_anti")


def decisions_current(deliveries: DataFrame, columns: tuple[str, ...] = WIDE) -> DataFrame:
    """Canonical deliveries of transactions without conflict, wide: one scan of the deliveries."""
    keep = tuple(c for c in dict.fromkeys((*KEYS, *columns)) if c != "transaction_id")
    stored = materialize(contents(deliveries, *keep).select("evaluation_id", "transaction_id", "_row.*"), "contents", compression="zstd")
    return _unambiguous(stored)


def decisions_summary(deliveries: DataFrame) -> DataFrame:
    """The same without snapshots and evidence, for charts and counts."""
    return decisions_current(deliveries, NARROW)


def decisions_of(deliveries: DataFrame, customer: str, columns: tuple[str, ...] = WIDE) -> DataFrame:
    """decisions_current of one customer, without reading the contents of others: the filter on the
    customer reaches the scan of the wide columns. Whether other customers share one of their
    evaluations or transactions is seen from the identities alone, a scan of three columns."""
    keep = tuple(c for c in dict.fromkeys((*KEYS, *columns)) if c != "transaction_id")
    mine = materialize(contents(deliveries.where(F.col("customer_id") == customer), *keep).select("evaluation_id", "transaction_id", "_row.*"), "mine", compression="zstd")
    ids = _identified(deliveries).select("evaluation_id", "transaction_id", "customer_id")
    others = ids.where(~F.coalesce(F.col("customer_id") == customer, F.lit(False)))
    own = mine.select("evaluation_id", "transaction_id")
    shared = others.join(if_small(own.select("evaluation_id").distinct()), "evaluation_id", "left_semi").select("evaluation_id").distinct()
    by_evaluation = own.join(shared, "evaluation_id", "left_semi").select("transaction_id")
    by_transaction = others.join(if_small(own.select("transaction_id").distinct()), "transaction_id", "left_semi").select("transaction_id")
    return _unambiguous(mine, by_evaluation.unionByName(by_transaction))


def latest_wins(deliveries: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The row of each key with the highest version (of equal ones the greatest row), as a replacing table keeps it."""
    one = deliveries.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(version), F.struct(*columns))).alias("_row"))
    return one.select(key, "_row.*")


def rejections_latest(rejections: DataFrame) -> DataFrame:
    keys = ["source_topic", "source_partition", "source_offset"]
    rest = [c for c in rejections.columns if c not in keys]
    # of equal times the greatest row, so that a task that runs again keeps the same
    one = rejections.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("observed_at", *rest)).alias("_row"))
    return one.select(*keys, "_row.*")


def storable(deliveries: DataFrame, currency: str = "EUR") -> DataFrame:
    """deliveries with row_error, null where a result may be stored, and stored_id, the identity it is
    stored under: its own, which must be well formed and the one its content gives, or, where it has
    none (null or empty), that of a legacy result."""
    c = F.col
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    named = F.lit(True)
    for f in ("decision_id", "event_id", "transaction_id", "customer_id"):
        named = named & (F.trim(f) != "") & (F.length(f) <= 256)
    right = identity.evaluation_id(c("event_id"), c("engine_version"), c("policy_id"), c("policy_version"))
    own = F.coalesce(c("evaluation_id"), F.lit("")) != ""
    return deliveries.withColumns({
        "stored_id": F.when(own, c("evaluation_id")).otherwise(identity.legacy_evaluation_id(c("event_id"))),
        "row_error": F.when(fails(named), "NAMES")
        .when(fails(c("risk_score").between(0, 100)), "SCORE")
        .when(fails(c("decision").isin("APPROVE", "REVIEW", "REJECT")), "DECISION")
        .when(fails(c("currency") == currency), "CURRENCY")
        .when(fails(c("amount_minor").between(1, 1_000_000_000_000)), "AMOUNT")
        .when(fails(c("policy_version") >= 0), "POLICY_VERSION")
        .when(fails(c("event_time") > 0), "EVENT_TIME")
        .when(fails(c("processed_at") > 0), "PROCESSED_AT")
        .when(own & fails(c("evaluation_id") == right), "IDENTITY"),
    })


# The tables that may be appended to
TABLES = ("evaluations", "payment_ingress", "processing_outcomes", "materializer_rejections")


def append(rows: DataFrame, root: str, table: str, batch_id: int | None = None) -> None:
    """Appends rows to a table of the store; with a batch_id, what the batch wrote before is replaced."""
    if table not in TABLES:
        raise ValueError(f"{table} is no table of the store")
    if batch_id is None:
        rows.write.mode("append").parquet(f"{root}/{table}/batch=-1")
    else:
        rows.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")


def materialise(deliveries: DataFrame, root: str, batch_id: int, observed_at: int) -> None:
    """Stores the results of a batch under their identities, and those that may not be stored as
    rejections with their place, their code and a hash of what they said (the quarantine)."""
    checked = storable(deliveries)
    good = checked.where("row_error IS NULL").withColumn("evaluation_id", F.col("stored_id")).drop("row_error", "stored_id")
    bad = checked.where("row_error IS NOT NULL")
    code = F.when(F.col("row_error") == "IDENTITY", "INVALID_EVALUATION_ID").otherwise("INVALID_DECISION")
    said = F.sha2(F.to_json(F.struct(*deliveries.columns), {"ignoreNullFields": "false"}), 256)
    append(good, root, "evaluations", batch_id)
    append(bad.select("source_topic", "source_partition", "source_offset", code.alias("error_code"), "row_error", said.alias("payload_sha256"), F.lit(observed_at).alias("observed_at")), root, "materializer_rejections", batch_id)

"""Immutable generations for readers: data first, the marker last.

A generation is a set of Parquet directories partitioned by its name. Readers trust only the
newest marker: READY and young enough, else nothing is served. A conflict or a quarantined
result blocks a generation, and with it older ones.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import overview, reconcile, store
from ledgerlens.session import delete, exists

CONTENT_TTL_MS, MARKER_TTL_MS, MAX_AGE_MS, SKEW_MS = 600_000, 86_400_000, 120_000, 5_000
WRITERS = 6
_MARKER = "generation string, started_at bigint, status string, assessments bigint, deliveries bigint, source_offsets string, build_ms bigint, reason string"
_SERVED = ("decision_id", "event_id", "transaction_id", "customer_id", "amount_minor", "currency", "risk_score", "decision", "matched_rules", "reason_codes", "rules_fingerprint", "event_time", "processed_at", "source_partition", "source_offset", "source_topic", "engine_version", "policy_id", "policy_version", "policy_snapshot", "rule_evidence", "input_sha256")


class Unavailable(RuntimeError):
    pass


@dataclass(frozen=True)
class Publication:
    generation: str
    started_at: int
    status: str
    assessments: int
    deliveries: int
    reason: str


def publish(deliveries: DataFrame, root: str, started_ms: int, rejections: DataFrame | None = None, generation: str | None = None, recent: bool = True) -> Publication:
    """Publishes what was ingested up to started_ms. recent: overviews look back from started_ms."""
    spark, began = deliveries.sparkSession, time.time()
    generation = generation or uuid.uuid4().hex
    n = {"assessments": 0, "deliveries": 0}
    offsets, status, reason = "[]", "READY", ""
    try:
        taken = deliveries.where(F.unix_millis(F.col("ingested_at").cast("timestamp")) <= started_ms)
        rows = store.evaluations_logical(taken, *_SERVED)
        path = f"{root}/evaluations/generation={generation}"
        # readers look up customers: rows of a customer lie together, and row groups have narrow ranges
        rows.repartitionByRange("customer_id").sortWithinPartitions("customer_id", "event_time", "evaluation_id").write.parquet(path)
        rows = spark.read.parquet(path)
        per_tx = rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n"))
        check = rows.agg(F.count(F.lit(1)).alias("assessments"), F.coalesce(F.sum("delivery_count"), F.lit(0)).alias("deliveries"), F.count_if(F.col("content_variants") != 1).alias("conflicts")).first()
        n = {"assessments": check.assessments, "deliveries": check.deliveries}
        ambiguous = per_tx.agg(F.count_if(F.col("_n") > 1)).first()[0]
        rejected = store.rejections_latest(rejections).count() if rejections is not None else 0
        if check.conflicts or ambiguous or rejected:
            raise Unavailable(f"{check.conflicts} conflicts, {ambiguous} ambiguous transactions, {rejected} quarantined")
        # one row per partition of the source
        offsets = json.dumps([[r.source_topic, r.source_partition, r.max_offset] for r in reconcile.source_offsets(rows).orderBy("source_topic", "source_partition").collect()])
        derived = [lambda: overview.customers(rows).repartitionByRange("customer_id").sortWithinPartitions("customer_id").write.parquet(f"{root}/customers/generation={generation}")]
        for window in overview.WINDOWS:
            new = overview.within(rows, started_ms, window) if recent else rows
            at = f"window={window}/generation={generation}"
            derived += [
                lambda new=new, at=at: overview.totals(new).coalesce(1).write.parquet(f"{root}/totals/{at}"),
                lambda new=new, at=at, window=window: overview.series(new, window).coalesce(1).write.parquet(f"{root}/series/{at}"),
                lambda new=new, at=at: overview.rule_matches(new).coalesce(1).write.parquet(f"{root}/rules/{at}"),
                lambda new=new, at=at: overview.latest(new.drop("policy_snapshot", "rule_evidence")).coalesce(1).write.parquet(f"{root}/latest/{at}"),
            ]
        with ThreadPoolExecutor(WRITERS) as pool:  # small jobs side by side; all have ended before the marker is written
            for done in [pool.submit(inheritable_thread_target(spark)(d)) for d in derived]:
                done.result()
    except Unavailable as e:
        status, reason = "BLOCKED", str(e)
    marker = [(generation, started_ms, status, n["assessments"], n["deliveries"], offsets, int((time.time() - began) * 1000), reason)]
    spark.createDataFrame(marker, _MARKER).coalesce(1).write.mode("append").parquet(f"{root}/publications")
    return Publication(generation, started_ms, status, n["assessments"], n["deliveries"], reason)


class Reader:
    """Reads the newest generation, or the one a cursor is pinned to as long as the newest is READY."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def publication(self, now_ms: int, pinned: str | None = None) -> str:
        try:
            marks = self.spark.read.schema(_MARKER).parquet(f"{self.root}/publications")
        except Exception as e:
            raise Unavailable("nothing published") from e
        newest = marks.orderBy(F.desc("started_at"), F.desc("generation")).first()
        if newest is None or newest.status != "READY":
            raise Unavailable("the newest generation is blocked")
        if not -SKEW_MS <= now_ms - newest.started_at <= MAX_AGE_MS:
            raise Unavailable("the newest generation is too old")
        if pinned is None or pinned == newest.generation:
            return newest.generation
        old = marks.where((F.col("generation") == pinned) & (F.col("status") == "READY")).first()
        if old is None or now_ms - old.started_at > CONTENT_TTL_MS:
            raise Unavailable("the generation of the cursor is gone")
        return pinned

    def _of(self, table: str, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/generation={generation}")

    def table(self, name: str, now_ms: int) -> DataFrame:
        """A table of the newest generation, as it is served."""
        return self._of(name, self.publication(now_ms))

    def overview(self, now_ms: int, window: str) -> dict[str, DataFrame]:
        g = self.publication(now_ms)
        return {t: self.spark.read.parquet(f"{self.root}/{t}/window={window}/generation={g}") for t in ("totals", "series", "rules", "latest")}

    def customers(self, now_ms: int, prefix: str = "", decision: str = "ALL", cursor: str = "") -> tuple[list[dict], str | None]:
        at = overview.decode_cursor(cursor, "customers", {"generation": str, "customer_id": str, "q": str})
        if at and at["q"] != f"{prefix}|{decision}":
            raise overview.CursorError("the cursor belongs to another search")
        g = self.publication(now_ms, at["generation"] if at else None)
        c = self._of("customers", g).where(F.col("customer_id").startswith(prefix) & (F.col("customer_id") > (at["customer_id"] if at else "")))
        if decision != "ALL":
            c = c.where(F.col({"APPROVE": "approved", "REVIEW": "review", "REJECT": "rejected"}[decision]) > 0)
        rows = c.orderBy("customer_id").limit(overview.PAGE + 1).withColumns({"generation": F.lit(g), "q": F.lit(f"{prefix}|{decision}")})
        return overview.page(rows, "customers", ("generation", "customer_id", "q"))

    def timeline(self, now_ms: int, customer: str, cursor: str = "") -> tuple[list[dict], str | None]:
        at = overview.decode_cursor(cursor, "timeline", {"generation": str, "customer_id": str, "event_time": int, "evaluation_id": str})
        if at and at["customer_id"] != customer:
            raise overview.CursorError("the cursor belongs to another customer")
        g = self.publication(now_ms, at["generation"] if at else None)
        rows = overview.timeline_page(self._of("evaluations", g).withColumn("generation", F.lit(g)), customer, (at["event_time"], at["evaluation_id"]) if at else None)
        return overview.page(rows, "timeline", ("generation", "customer_id", "event_time", "evaluation_id"))


def retain(spark: SparkSession, root: str, now_ms: int) -> list[str]:
    """Deletes the content of generations older than ten minutes, however old, and the markers of those
    older than a day, the newest excepted in both; returns the names of generations whose content went."""
    marks = spark.read.schema(_MARKER).parquet(f"{root}/publications").withColumn("file", F.input_file_name())
    known = marks.orderBy(F.desc("started_at"), F.desc("generation")).select("generation", "started_at", "file").collect()  # one row per generation that has a marker
    old = [r for r in known[1:] if now_ms - r.started_at > CONTENT_TTL_MS]
    gone = [r.generation for r in old if exists(spark, f"{root}/evaluations/generation={r.generation}")]
    for g in gone:
        for t in ("customers", *(f"{t}/window={w}" for t in ("totals", "series", "rules", "latest") for w in overview.WINDOWS), "evaluations"):
            delete(spark, f"{root}/{t}/generation={g}")
    for r in old:
        if now_ms - r.started_at > MARKER_TTL_MS:  # a marker is one file, written by one publication
            delete(spark, r.file)
    return gone

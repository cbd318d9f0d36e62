"""The scoring job from wire records to stored results.

Four streams over directories, each with a checkpoint of its own:

  archive   wire records -> store/payment_ingress, exact bytes, before anything is decoded
  rules     wire records of the control topic -> rules, the valid updates; dlq, the others
  admit     wire records -> decoded -> validated -> one per event_id -> one per transaction_id ->
            admitted, each payment with the policy in force; dlq, dead letters; conflicts
  score     admitted -> decisions and late, by event time and watermark

and `materialise`, which takes the outputs of `score` and `admit` into the tables of the store.

Validation comes before the watermark, so that no invalid time moves it. Redeliveries are dropped
by a time-to-live in processing time, a clock that `score` cannot have beside its watermark: hence
two streams. What a micro-batch of one stream hands to the next becomes visible by one rename of a
directory, and a batch that runs again finds it there: the effect is exactly once, and a payment
keeps the policy that it was admitted with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.policy import Policy, rule_error_column, updated
from ledgerlens.operators import store, validate
from ledgerlens.session import delete, exists, materialize, release
from ledgerlens.settings import Settings
from ledgerlens.sources import avro, schemas, streams
from ledgerlens.streaming import scoring

AT = ("source_topic", "source_partition", "source_offset", "source_timestamp")
WIRE = T.StructType([*schemas.COORDINATES.fields, T.StructField("key", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])))])
ADMITTED = T.StructType([*schemas.TRANSACTION.fields, T.StructField("policy", T.StringType())])


def put_once(df: DataFrame, path: str, batch_id: int) -> bool:
    """Writes df as path/batch=<id>, visible by one rename; nothing is done if it is there already."""
    spark, at = df.sparkSession, f"{path}/batch={batch_id}"
    if exists(spark, at):
        return False
    made = f"{path}/_made-{uuid.uuid4().hex}"  # readers pass over names that begin with _
    df.write.parquet(made)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (made, at))
    if not a.getFileSystem(conf).rename(a, b):
        delete(spark, made)
        if not exists(spark, at):
            raise OSError(f"{at} could not be made")
    return True


class Pipeline:
    """The streams of a job under one directory. writers: schemas of binary bodies by schema id; bodies
    are JSON if there are none."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy, settings: Settings | None = None, writers: Mapping[int, Any] | None = None, rule_writers: Mapping[int, Any] | None = None, fixed: bool = False):
        self.spark, self.root, self.base, self.settings = spark, root.rstrip("/"), policy, settings or Settings()
        self.writers, self.rule_writers, self.fixed = writers, rule_writers, fixed

    def _start(self, df: DataFrame, name: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
        w = df.writeStream.queryName(f"{name}-{uuid.uuid4().hex[:8]}").foreachBatch(put).option("checkpointLocation", f"{self.root}/checkpoints/{name}").outputMode(mode)
        return w.trigger(availableNow=True).start() if name != "admit" else w.start()

    def _read(self, name: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
        spark = self.spark
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
        return streams.file_stream(spark, f"{self.root}/{name}", schema, max_files=max_files)

    def _decoded(self, wire: DataFrame, schema: T.StructType, writers: Mapping[int, Any] | None) -> DataFrame:
        """Coordinates, payload, the fields of schema and error_code: PAYLOAD_TOO_LARGE, DESERIALIZATION_ERROR or SCHEMA_ERROR."""
        large = validate.too_large(F.col("payload"))
        if writers is not None:
            small = F.when(~large, F.col("payload"))
            rows = wire.withColumn("_r", avro.decoded(small, writers, schema))
            rows = rows.select(*AT, "payload", "_r.*")
        else:
            rows = streams.json_records(wire.select(*AT, "payload", *streams.framed()), schema)
            rows = rows.withColumn("decode_error", F.coalesce("frame_error", "decode_error"))
        return rows.withColumn("error_code", F.when(large, "PAYLOAD_TOO_LARGE").otherwise(F.col("decode_error"))).select(*AT, "payload", *schema.names, "error_code")

    def policy(self) -> Policy:
        """The rules in force: those of the job, or with the updates that have come, unless the job has a fixed catalogue."""
        if self.fixed or not exists(self.spark, f"{self.root}/rules"):
            return self.base
        return updated(self.base, self.spark.read.schema(schemas.RULE).parquet(f"{self.root}/rules"))

    def _letters(self, bad: DataFrame) -> DataFrame:
        return validate.dead_letters(bad, mode=self.settings.dlq_payload)

    def archive(self, wire: DataFrame) -> StreamingQuery:
        rows = validate.archive_rows(wire.withColumn("timestamp_type", F.lit("CreateTime")))
        return self._start(rows, "archive", lambda b, i: store.append(b, f"{self.root}/store", "payment_ingress", i))

    def rules(self, wire: DataFrame) -> StreamingQuery:
        rows = self._decoded(wire, schemas.RULE, self.rule_writers)
        tagged = rows.withColumn("error_code", F.coalesce("error_code", rule_error_column()))

        def put(b: DataFrame, i: int) -> None:
            put_once(b.where("error_code IS NULL").select(*schemas.RULE.names), f"{self.root}/rules", i)
            put_once(self._letters(b.where("error_code IS NOT NULL")), f"{self.root}/dlq-rules", i)

        return self._start(tagged, "rules", put)

    def admit(self, wire: DataFrame, strict: bool = False) -> StreamingQuery:
        """strict: another content under a known identity fails the job; else it is a row of `conflicts`."""
        rows = self._decoded(wire, schemas.TRANSACTION, self.writers)
        observed = F.coalesce("source_timestamp", F.lit(0))
        tagged = rows.withColumn("error_code", F.coalesce("error_code", validate.error_code(observed)))
        once = scoring.first_only(tagged, ("event_id", "transaction_id"), self.settings.dedup_ms, strict)

        def put(b: DataFrame, i: int) -> None:
            b = materialize(b, "admitted")
            text = scoring.policy_text(self.policy())
            put_once(b.where("kind = 'FIRST'").select(*schemas.TRANSACTION.names).withColumn("policy", F.lit(text)), f"{self.root}/admitted", i)
            put_once(self._letters(b.where("kind = 'INVALID'")), f"{self.root}/dlq", i)
            put_once(b.where("kind = 'CONFLICT'").select(*AT, "event_id", "transaction_id"), f"{self.root}/conflicts", i)
            release(b)

        return self._start(once, "admit", put)

    def score(self) -> StreamingQuery:
        out = scoring.score_stream(self._read("admitted", ADMITTED), self.base, self.settings.disorder_ms)

        def put(b: DataFrame, i: int) -> None:
            b = materialize(b, "scored")
            put_once(b.where("kind = 'DECISION'").select(*schemas.DECISION.names), f"{self.root}/decisions", i)
            late = b.where("kind = 'LATE'").select(F.to_json(F.struct(*schemas.TRANSACTION.names)).alias("transaction"), "customer_id", "watermark", "lateness_ms", F.unix_millis(F.current_timestamp()).alias("observed_at"), F.lit("LATE_EVENT").alias("reason"))
            put_once(late, f"{self.root}/late", i)
            release(b)

        return self._start(out, "score", put)

    def materialise(self, name: str) -> StreamingQuery:
        """The consumer of an output (decisions, dlq or late) into the store."""
        at = f"{self.root}/store"
        if name == "decisions":
            # an output has no place of its own but its file: the batch it came with and its number there
            rows = self._read(name, schemas.DECISION).withColumn("rule_evidence", F.to_json("rule_evidence"))

            def put(b: DataFrame, i: int) -> None:
                placed = b.withColumns({"source_topic": F.lit("risk.decisions"), "source_partition": F.spark_partition_id(), "source_offset": F.monotonically_increasing_id(), "ingested_at": F.current_timestamp()})
                placed = materialize(placed, "results")
                store.materialise(placed, at, i, 0)
                release(placed)

            return self._start(rows, "store-decisions", put)
        schema, outcomes = {"dlq": (schemas.DEAD_LETTER, validate.invalid_outcomes), "late": (schemas.LATE_EVENT, validate.late_outcomes)}[name]
        number = {"dlq": 0, "late": 1}[name]

        def put_outcomes(b: DataFrame, i: int) -> None:
            checked = outcomes(b)
            store.append(checked.where("row_error IS NULL").drop("row_error"), at, "processing_outcomes", 2 * i + number)  # batches of two outputs side by side

        return self._start(self._read(name, schema), f"store-{name}", put_outcomes)

"""Stream sources and sinks of records, and the framing of binary payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.reconcile import position_digest


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 64, max_bytes: int | None = None) -> DataFrame:
    """A directory as an append-only topic. max_files, or max_bytes if given, bounds a micro-batch; a
    file above max_bytes is a batch of its own."""
    limit = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(schema).format(fmt).option(*limit).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A topic of a broker in the wire columns of this package; needs Spark's Kafka connector.
    Only committed records are read, and a gap in the log stops the query."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true", "kafka.isolation.level": "read_committed", "includeHeaders": "true"})
    return wire(raw.load())


def wire(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.unix_millis("timestamp").alias("source_timestamp"), "key", F.col("value").alias("payload"), "headers")


def bounded(records: DataFrame, ranges: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """The records of [from, to) per (topic, partition): a bounded read for a replay."""
    where: Column = F.lit(False)
    for (topic, partition), (lo, hi) in ranges.items():
        where = where | ((F.col("source_topic") == topic) & (F.col("source_partition") == partition) & (F.col("source_offset") >= lo) & (F.col("source_offset") < hi))
    return records.where(where)


def replay(records: DataFrame, ranges: dict[tuple[str, int], tuple[int, int]], target: str, execute: bool = False, most: int = 1_000_000, audit: str | None = None, files: int | None = None) -> dict[str, int]:
    """Appends the records of the ranges to a Parquet directory; counts only, unless execute. More than `most`
    records are refused whole. audit: a directory to which what was read is appended, per partition of the
    source its records, its first and last offset and the digest of its positions. files: records are
    written as so many files, of which a stream takes a bounded number at a time (maxFilesPerTrigger)."""
    part = bounded(records, ranges)
    n = part.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} records to replay")
    if audit:
        position_digest(part).withColumns({"target": F.lit(target), "executed": F.lit(execute), "at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(audit)
    if execute:
        (part.repartition(files) if files else part).write.mode("append").parquet(target)
    return {"records": n, "written": n if execute else 0}


def first_offsets_are_zero(records: DataFrame) -> Column:
    return F.min("source_offset") == 0


def framed(payload: str = "payload") -> list[Column]:
    """(schema_id, body, frame_error) of a payload framed as a zero byte, a four-byte schema id and a
    body: the body stays binary, for a decoder that knows the schema."""
    p = F.col(payload)
    ok = (F.octet_length(p) >= 5) & (F.hex(F.substring(p, 1, 1)) == "00")
    big = F.conv(F.hex(F.substring(p, 2, 4)), 16, 10).cast("bigint")
    ident = F.when(big >= 1 << 31, big - (1 << 32)).otherwise(big).cast("int")
    return [
        F.when(F.coalesce(ok, F.lit(False)), ident).otherwise(F.lit(-1)).alias("schema_id"),
        F.when(F.coalesce(ok, F.lit(False)), F.expr(f"substring({payload}, 6)")).alias("body"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("DESERIALIZATION_ERROR")).alias("frame_error"),
    ]


def json_records(records: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """Typed columns of JSON bodies; decode_error where a body is not a JSON object of the schema."""
    text = F.col(body).cast("string")
    parsed = F.from_json(text, T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = records.withColumn("_r", parsed)
    bad = text.isNull() | F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return df.select("*", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields if f.name not in records.columns], F.when(bad, F.lit("DESERIALIZATION_ERROR")).alias("decode_error")).drop("_r")

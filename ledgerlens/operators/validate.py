"""Ordered validation of payments, and dead letters."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import identity
from ledgerlens.sources import schemas

IDS = ("event_id", "transaction_id", "customer_id", "merchant_id", "device_id")
MAX_PAYLOAD, CAPTURED = 1_048_576, 4_096
# The codes a dead letter may carry
CODES = (
    "DESERIALIZATION_ERROR", "SCHEMA_ERROR", "PAYLOAD_TOO_LARGE", "MISSING_REQUIRED_FIELD", "INVALID_AMOUNT", "INVALID_CURRENCY",
    "INVALID_COUNTRY", "INVALID_STATUS", "INVALID_EVENT_TIME", "UNKNOWN_RULE_TYPE", "INVALID_RULE_CONFIGURATION",
)


@lru_cache(1)
def iso_countries() -> tuple[str, ...]:
    """The two-letter codes of ISO 3166 that the session's Java runtime knows."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return tuple(sorted(spark.sparkContext._jvm.java.util.Locale.getISOCountries()))


def _base64(c: Column) -> Column:
    """Base64 on one line; Spark breaks it after 76 characters."""
    return F.translate(F.base64(c), "\r\n", "")


def error_code(observed_at: Column, countries: tuple[str, ...] | None = None, currency: str = "EUR") -> Column:
    """The code of the first check a payment fails, in a fixed order; null if it passes.
    A null field fails its check. countries: the allowed codes; those of ISO 3166 if None."""
    c = F.col
    countries = countries or iso_countries()
    missing = F.lit(False)
    for f in IDS:
        missing = missing | c(f).isNull() | (F.trim(f) == "") | (F.length(f) > 128)
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(missing, "MISSING_REQUIRED_FIELD")
        .when(fails(c("amount_minor").between(1, 1_000_000_000_000)), "INVALID_AMOUNT")
        .when(fails(c("currency") == currency), "INVALID_CURRENCY")
        .when(fails(c("country").isin(*countries)), "INVALID_COUNTRY")
        .when(fails(c("status").isin("APPROVED", "DECLINED")), "INVALID_STATUS")
        .when(fails((c("event_time") > 0) & (F.try_subtract("event_time", F.lit(300_000)) <= observed_at)), "INVALID_EVENT_TIME")
    )


def allowed_code(code: Column) -> Column:
    """code up to its first colon, or DESERIALIZATION_ERROR if that is not a known one."""
    head = F.split(F.coalesce(code, F.lit("")), ":")[0]
    return F.when(head.isin(*CODES), head).otherwise(F.lit("DESERIALIZATION_ERROR"))


def split_valid(df: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with error_code): one projection, two filters on it."""
    tagged = df.withColumn("error_code", code)
    return tagged.where(F.col("error_code").isNull()).drop("error_code"), tagged.where(F.col("error_code").isNotNull())


def too_large(payload: Column) -> Column:
    return F.coalesce(F.octet_length(payload) > MAX_PAYLOAD, F.lit(False))


def dead_letters(invalid: DataFrame, payload: str = "payload", mode: str = "omit", observed_at: Column | None = None) -> DataFrame:
    """Dead letters of rows with coordinates, a binary payload and error_code. mode 'capture'
    keeps the first 4096 bytes in Base64, 'omit' none; size and hash are kept always. The schema
    id stands in bytes 1..4 of a framed payload, else it is -1."""
    if mode not in ("omit", "capture"):
        raise ValueError("mode is omit or capture")
    p = F.col(payload)
    size = F.coalesce(F.octet_length(p), F.lit(0))
    framed = (size >= 5) & (F.hex(F.substring(p, 1, 1)) == "00")
    schema_id = F.conv(F.hex(F.substring(p, 2, 4)), 16, 10).cast("bigint")
    signed = F.when(schema_id >= 1 << 31, schema_id - (1 << 32)).otherwise(schema_id)
    return invalid.select(
        F.concat_ws(":", "source_topic", "source_partition", "source_offset").alias("error_id"),
        "source_topic", "source_partition", "source_offset", "source_timestamp",
        F.when(framed, signed).otherwise(F.lit(-1)).cast("int").alias("schema_id"),
        (observed_at if observed_at is not None else F.unix_millis(F.current_timestamp())).alias("observed_at"),
        allowed_code(F.col("error_code")).alias("error_code"),
        F.lit("Rejected payment record").alias("error_message"),
        (F.coalesce(_base64(F.substring(p, 1, CAPTURED)), F.lit("")) if mode == "capture" else F.lit("")).alias("raw_payload"),
        ((size > 0) & (F.lit(mode == "omit") | (size > CAPTURED))).alias("payload_truncated"),
        F.sha2(F.coalesce(p, F.lit(b"")), 256).alias("payload_sha256"),
        size.cast("bigint").alias("payload_bytes"),
        F.lit(mode).alias("payload_mode"),
    )


def archive_rows(records: DataFrame) -> DataFrame:
    """Exact wire records as archive rows: null flags, Base64, size, hash, headers as JSON.
    Columns: coordinates, timestamp_type, key and payload (binary), headers (array of structs)."""
    key, value = F.col("key"), F.col("payload")
    return records.select(
        "source_topic", "source_partition", "source_offset", "source_timestamp", "timestamp_type",
        key.isNull().alias("key_is_null"), value.isNull().alias("value_is_null"),
        F.coalesce(_base64(key), F.lit("")).alias("key_base64"),
        F.coalesce(_base64(value), F.lit("")).alias("payload_base64"),
        F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint").alias("payload_bytes"),
        F.sha2(F.coalesce(value, F.lit(b"")), 256).alias("payload_sha256"),
        F.to_json(F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].isNull().alias("is_null"), F.coalesce(_base64(h["value"]), F.lit("")).alias("value_base64")))).alias("headers_json"),
    )


def late_outcomes(records: DataFrame) -> DataFrame:
    """Outcome rows of late records (schemas.LATE_EVENT), each with row_error: the first check it
    fails, null if it passes. The record must name the event and the customer of its transaction,
    and its lateness must be what lies between event time and watermark."""
    t, c = F.col("transaction"), F.col
    event, customer = F.get_json_object(t, "$.event_id"), F.get_json_object(t, "$.customer_id")
    at = F.coalesce(F.get_json_object(t, "$.event_time").try_cast("bigint"), F.lit(0))
    watermark = F.coalesce(c("watermark"), F.lit(0))
    error = (
        F.when(~F.coalesce(c("observed_at") > 0, F.lit(False)), "OBSERVED_AT")
        .when(F.coalesce(F.trim(event), F.lit("")) == "", "EVENT")
        .when(~customer.eqNullSafe(c("customer_id")), "CUSTOMER")
        .when(watermark < at, "WATERMARK")
        .when(~F.coalesce(c("lateness_ms") == F.try_subtract(watermark, at), F.lit(False)), "LATENESS")
    )
    facts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRANSACTION.fields if f.name in identity.FACTS)
    read = records.select(event.alias("_event"), "watermark", "lateness_ms", "observed_at", F.coalesce("reason", F.lit("")).alias("reason"), error.alias("row_error"), F.from_json(t, facts).alias("_t"))
    hashed = read.select("*", "_t.*").withColumn("input_sha256", identity.input_hash())
    return hashed.select(
        F.lit("LATE").alias("outcome"), "observed_at", F.lit("").alias("input_topic"), F.lit(-1).alias("input_partition"), F.lit(-1).cast("bigint").alias("input_offset"),
        F.lit("").alias("payload_sha256"), F.col("_event").alias("event_id"), "input_sha256", "reason", "watermark", "lateness_ms", "row_error",
    )


def invalid_outcomes(letters: DataFrame) -> DataFrame:
    """The same of dead letters (schemas.DEAD_LETTER), which name the place of an input, its hash and a code."""
    c = F.col
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    error = (
        F.when(fails(c("observed_at") > 0), "OBSERVED_AT")
        .when(fails((F.trim("source_topic") != "") & (c("source_partition") >= 0) & (c("source_offset") >= 0)), "COORDINATES")
        .when(fails(c("payload_sha256").rlike(r"^[0-9a-f]{64}\z")), "HASH")
        .when(fails(F.trim("error_code") != ""), "CODE")
    )
    zero = F.lit(0).cast("bigint")
    return letters.select(
        F.lit("INVALID").alias("outcome"), "observed_at", c("source_topic").alias("input_topic"), c("source_partition").alias("input_partition"), c("source_offset").alias("input_offset"),
        "payload_sha256", F.lit("").alias("event_id"), F.lit("").alias("input_sha256"), c("error_code").alias("reason"), zero.alias("watermark"), zero.alias("lateness_ms"), error.alias("row_error"),
    )

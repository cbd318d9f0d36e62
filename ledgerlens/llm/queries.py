"""Queries p5 and p8..p10 over the tables of a directory, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import latency, mixing, packing, spam


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return latency.slow_evaluations(_table(spark, d, "evaluations"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return latency.latency_percentiles(_table(spark, d, "evaluations"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(packing.pack(_table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(_table(spark, d, "documents")))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.invariants(_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "source_targets")).report().where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "source_targets")).report()


def p9_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "source_targets")).records


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(_table(spark, d, "documents"), _table(spark, d, "source_targets")).invariants()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_table(spark, d, "documents"))


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    return spam.label_pages(_table(spark, d, "documents"))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per page its length, and whether every character of it has exactly one label."""
    p = spam.label_pages(_table(spark, d, "documents"))
    return p.select("doc_id", "chars", (sum((p[x] for x in spam.LABELS), p["chars"] * 0) == p["chars"]).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p5_found, p5_percentiles, p8_found, p8_containers, p8_invariants, p9_found, p9_shares, p9_records, p9_invariants, p10_found, p10_labels, p10_invariants)
}
_KEPT = """kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY ingested_at, source_partition, source_offset) AS rn,
           count(*) OVER (PARTITION BY evaluation_id) AS copies
    FROM evaluations WHERE evaluation_id <> '') WHERE rn = 1)"""
_LATENCY = f"""WITH {_KEPT}, lat AS (
  SELECT evaluation_id, decision, processed_at - event_time AS latency FROM kept
  WHERE decision IS NOT NULL AND processed_at IS NOT NULL)"""
# Sizes in words, numbers and signs: no document lies so near a limit that a tokenizer's own sizes would change the cases
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]'))"
_SIZED = f"""WITH s AS (SELECT source, count(*) AS records, sum({_SIZE}) AS size FROM documents GROUP BY 1),
t AS (SELECT t.*, coalesce(records, 0) AS records, coalesce(size, 0) AS size, sum(coalesce(size, 0)) OVER () AS total FROM source_targets t LEFT JOIN s USING (source))"""
SQL: dict[str, str] = {
    "p8_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > 4096",
    "p8_invariants": f"SELECT count(*) AS documents, count(*) AS packed, count(*) FILTER ({_SIZE} > 4096) AS split, 0 AS broken, 0 AS overfull, false AS slack FROM documents",
    "p9_found": f"{_SIZED} SELECT source FROM t WHERE size * max_repeats < target_share * total",
    "p10_invariants": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, true AS whole FROM documents",
    "p9_invariants": f"{_SIZED} SELECT source, target_share, records, false AS over, false AS off, size * max_repeats < target_share * total AS short FROM t",
    "p5_found": f"{_LATENCY}, m AS (SELECT decision, quantile_disc(latency, 0.5) AS med FROM lat GROUP BY 1) SELECT evaluation_id FROM lat JOIN m USING (decision) WHERE latency > 10 * med",
    "p5_percentiles": f"""{_LATENCY}, ranked AS (
  SELECT decision, latency AS value, row_number() OVER (PARTITION BY decision ORDER BY latency) AS rank, count(*) OVER (PARTITION BY decision) AS count FROM lat),
targets AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS p)
SELECT decision, p, value, count FROM ranked, targets WHERE rank = greatest(1, CAST(ceil(p * count) AS BIGINT))""",
}

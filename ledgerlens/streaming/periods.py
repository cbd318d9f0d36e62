"""Late and out-of-order records as streams: sessions and period totals that late records correct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import late_periods
from ledgerlens.operators.sessions import CELL_MS, GAP_MS, Intervals
from ledgerlens.session import exists, if_small, materialize, release


def session_stream(events: DataFrame, keys: Sequence[str], gap_ms: int = GAP_MS, lateness_ms: int = late_periods.CUTOFF_MS) -> DataFrame:
    """Sessions of a stream with event_time (ms): every event opens an interval as
    long as the gap, intervals that overlap or touch merge in the state of their key, and a
    session comes out once the watermark has passed it."""
    timed = events.where(F.col("event_time").isNotNull()).withColumn("ts", F.timestamp_millis("event_time")).withWatermark("ts", f"{lateness_ms} milliseconds")
    s = timed.groupBy(*keys, F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    return s.agg(F.min("event_time").alias("started_at"), F.max("event_time").alias("ended_at"), F.count(F.lit(1)).alias("n")).drop("w")


class PeriodTable:
    """Partial aggregates per period and arrival batch in a directory, added to batch by batch.

    Every batch writes, under its own id and replacing what it wrote before if it runs again:
    partials, the refused deliveries, the identities it accepted (by day of event time), and the
    highest usable time per source partition so far. A batch is held against the times that the
    batches before reached, so that closed periods refuse it, and against earlier identities, so
    that a payment delivered again counts once; only days from its oldest payment on are read for
    that. Batches come in the order of offsets."""

    PARTIALS = "period_start bigint, source_partition int, arrival_batch bigint, n bigint, amount_minor bigint, batch bigint"
    REFUSED = "source_partition int, source_offset bigint, batch bigint"
    SEEN = "event_id string, day bigint, batch bigint"
    REACHED = "source_partition int, top bigint, batch bigint"

    def __init__(self, path: str, cutoff_ms: int = late_periods.CUTOFF_MS, period_ms: int = late_periods.PERIOD_MS):
        self.path, self.cutoff_ms, self.period_ms = path, cutoff_ms, period_ms

    def _of(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        if not exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, deliveries: DataFrame, batch_id: int) -> None:
        spark = deliveries.sparkSession
        last = self._of(spark, "reached", self.REACHED).where(F.col("batch") < batch_id)
        reached = last.where(F.col("batch") == (last.agg(F.max("batch")).first()[0] if batch_id else -1)).select("source_partition", "top")
        admitted = late_periods.admit(deliveries, *late_periods.FIELDS, cutoff_ms=self.cutoff_ms, period_ms=self.period_ms, reached=reached)
        day = F.expr("event_time div 86400000").alias("day")
        good = materialize(late_periods.accepted(admitted).select("*", day), "good")
        oldest = good.agg(F.min("day")).first()[0]
        seen = self._of(spark, "seen", self.SEEN).where((F.col("batch") < batch_id) & (F.col("day") >= F.lit(oldest or 0)))
        new = materialize(good.join(seen.select("event_id"), "event_id", "left_anti"), "accepted")
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        put(late_periods.partial_aggregates(new, self.period_ms), "partials")
        put(admitted.where("refused").select("source_partition", "source_offset"), "refused")
        fresh = new.select("event_id", "day").withColumn("batch", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/seen")
        tops = admitted.where("usable").groupBy("source_partition").agg(F.max("event_time").alias("top")).unionByName(reached)
        put(tops.groupBy("source_partition").agg(F.max("top").alias("top")).coalesce(1), "reached")
        release(good)
        release(new)

    def read(self, spark: SparkSession) -> DataFrame:
        return late_periods.combine(self._of(spark, "partials", self.PARTIALS))

    def refused(self, spark: SparkSession) -> DataFrame:
        return self._of(spark, "refused", self.REFUSED).select("source_partition", "source_offset")


class SessionTable:
    """Interval state of sessions in a directory, added to batch by batch, late ones included.

    A batch rewrites the cells that it touches, under its own id: what a cell held is read from
    the last batch before that touched it, so that a batch that runs again replaces itself. Events
    have to be distinct: a payment delivered again is dropped before (scoring.once_stream)."""

    def __init__(self, path: str, keys: Sequence[str], gap_ms: int = GAP_MS, cell_ms: int = CELL_MS):
        self.path, self.intervals = path, Intervals(keys, gap_ms, cell_ms)
        self.schema = ", ".join([*[f"{k} string" for k in self.intervals.named], "started_at bigint, ended_at bigint, until bigint, n bigint, _cell bigint, batch bigint"])

    def _state(self, spark: SparkSession, before: int) -> DataFrame:
        if not exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(self.path).where(F.col("batch") < before)
        newest = rows.groupBy("_cell").agg(F.max("batch").alias("batch"))  # from the names of directories
        return rows.join(if_small(newest), ["_cell", "batch"], "left_semi")

    def add(self, events: DataFrame, batch_id: int) -> None:
        new = materialize(self.intervals.merged(self.intervals.opened(events)), "opened")
        touched = self._state(events.sparkSession, batch_id).join(if_small(new.select("_cell").distinct()), "_cell", "left_semi").drop("batch")
        merged = materialize(self.intervals.merged(touched, new).withColumn("batch", F.lit(batch_id)), "merged")
        merged.repartition("_cell", F.pmod(F.xxhash64(*self.intervals.named), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_cell", "batch").parquet(self.path)
        release(new)
        release(merged)

    def read(self, spark: SparkSession, watermark: int | None = None) -> DataFrame:
        return self.intervals.read(self._state(spark, 1 << 62).drop("batch"), watermark)


def route(tagged: DataFrame, path: str, checkpoint: str, column: str = "kind"):
    """Writes a tagged stream to one directory per tag. A micro-batch is one directory under each
    tag, replaced if the batch runs again: the effect is exactly once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column, "batch").parquet(path)

    return tagged.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")

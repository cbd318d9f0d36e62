"""Exact nearest-rank percentiles per group, at any number of rows and of distinct values.

Values are counted, the counts are range-sorted by (group, value) and written with the ordinal
of their range. Sums per range tell which range holds a target rank; running sums are taken in
these ranges only. No task sorts a group, and nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def nearest_ranks(df: DataFrame, group: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """(group, p, value, count): the value of rank ceil(p * count), 1 at least. Rows with a null value
    or group are left out; a group without rows has no percentiles."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = kept.groupBy(group, F.col(value).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # written, as the ordinals must not change if a task runs again
    ranged = materialize(counts.repartitionByRange(n, group, "value").withColumn("_range", F.spark_partition_id()), "ranks")
    # groups x ranges rows
    sizes = ranged.groupBy(group, "_range").agg(F.sum("n").alias("_n"))
    below = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_range", "_n", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy(group)).alias("count"))
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("count")), F.lit(1)).alias("rank")) for p in probabilities])
    held = F.filter(targets, lambda t: (t["rank"] > F.col("_below")) & (t["rank"] <= F.col("_below") + F.col("_n")))
    wanted = sizes.withColumn("_targets", held).where(F.size("_targets") > 0).drop("_n")
    running = Window.partitionBy(group, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.join(wanted, [group, "_range"]).withColumn("_cum", F.col("_below") + F.sum("n").over(running))
    # the row that first reaches a rank is the one whose own values straddle it
    hit = F.filter("_targets", lambda t: (t["rank"] <= F.col("_cum")) & (t["rank"] > F.col("_cum") - F.col("n")))
    return cum.withColumn("_t", F.explode(hit)).select(group, F.col("_t.p").alias("p"), "value", "count")

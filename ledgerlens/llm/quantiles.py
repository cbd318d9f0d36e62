"""Percentiles per group over very many values, by cumulative frequencies.

1. Reduce to (group, value, n): a mergeable summary. Summaries of days, files or partitions
   add up (merge_counts).
2. Range-sort the counts by (group, value); the ordinal of the range partition is written
   with the rows.
3. Add each partition's offset (the counts of the group in lower partitions, a table of
   partitions x groups rows) to a running sum inside the partition.
4. The first value whose cumulative count reaches a target rank is the percentile.

No group is sorted by one task: a group that holds most values spreads over many ranges.
Results are exact. Only where a caller asks for `bits`, values are cut to that many significant
binary digits before counting, which bounds the relative error by 2**(1 - bits) and the summary by
64 * 2**bits values per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def rounded(value: Column, bits: int | None = None) -> Column:
    """value (bigint) cut to its leading bits, towards 0; exact below 2**bits, and everywhere if bits is None."""
    if bits is None:
        return value
    size = F.length(F.bin(F.when(value < 0, -(value + 1)).otherwise(value)))  # no magnitude overflows
    shift = F.greatest(size - F.lit(bits), F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.when(shift > 0, (value.cast("bigint") - value % unit)).otherwise(value.cast("bigint"))


def value_counts(df: DataFrame, group: Sequence[str], value: str, bits: int | None = None) -> DataFrame:
    """The summary (group..., value, n). Rows with a null value or a null group are left out."""
    kept = df.where(F.col(value).isNotNull())
    for g in group:
        kept = kept.where(F.col(g).isNotNull())
    return kept.groupBy(*group, rounded(F.col(value), bits).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(a: DataFrame, *more: DataFrame) -> DataFrame:
    for b in more:
        a = a.unionByName(b)
    return a.groupBy(*[c for c in a.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, group: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(group..., p, value, count): the nearest-rank percentile, the value of rank ceil(p * count).

    A tie needs no rule, since equal values are one row. An empty summary gives no rows."""
    group = list(group)
    spark = counts.sparkSession
    sort = [*group, "value"]
    # written, as the ordinals must not change if a task runs again
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    below = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sizes = ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
    offsets = sizes.select(*group, "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("count"))
    running = Window.partitionBy(*group, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.withColumn("_cum", F.sum("n").over(running)).join(offsets, [*group, "_range"])
    cum = cum.withColumn("_cum", F.col("_cum") + F.col("_offset"))
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("count")), F.lit(1)).alias("rank")) for p in probabilities])
    # the row that first reaches a rank is the one whose own values straddle it
    hit = cum.withColumn("_t", F.explode(F.filter(targets, lambda t: (t["rank"] <= F.col("_cum")) & (t["rank"] > F.col("_cum") - F.col("n")))))
    return hit.select(*group, F.col("_t.p").alias("p"), "value", "count")

"""Every input against its outcome; latencies; positions of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import nearest_ranks
from ledgerlens.session import if_small


def outcomes(inputs: DataFrame, evaluated: DataFrame, invalid: DataFrame, late: DataFrame) -> DataFrame:
    """One row per distinct input event_id with evaluated, invalid, late (flags) and state:
    EVALUATED, INVALID, LATE, UNRESOLVED (none of them) or CONTRADICTED (more than one)."""
    flag = lambda df, name: df.select("event_id").where(F.col("event_id").isNotNull()).distinct().withColumn(name, F.lit(True))
    out = inputs.select("event_id").where(F.col("event_id").isNotNull()).distinct()
    for df, name in ((evaluated, "evaluated"), (invalid, "invalid"), (late, "late")):
        out = out.join(flag(df, name), "event_id", "left")
    out = out.na.fill(False)
    n = F.col("evaluated").cast("int") + F.col("invalid").cast("int") + F.col("late").cast("int")
    return out.withColumn("state", F.when(n > 1, "CONTRADICTED").when(F.col("evaluated"), "EVALUATED").when(F.col("invalid"), "INVALID").when(F.col("late"), "LATE").otherwise("UNRESOLVED"))


def report(states: DataFrame) -> DataFrame:
    s = F.col("state")
    kinds = ("EVALUATED", "INVALID", "LATE", "UNRESOLVED", "CONTRADICTED")
    return states.agg(F.count(F.lit(1)).alias("inputs"), *[F.count_if(s == k).alias(k.lower()) for k in kinds])


def unexpected(outcomes_of: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outcomes of events that never came in."""
    return outcomes_of.where(F.col("event_id").isNotNull()).select("event_id").distinct().join(inputs.select("event_id"), "event_id", "left_anti")


def set_difference(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, unexpected or carry another value."""
    e = expected.select(key, F.col(value).alias("expected"), F.lit(1).alias("_e"))
    a = actual.select(key, F.col(value).alias("actual"), F.lit(1).alias("_a"))
    j = e.join(a, key, "full")
    what = F.when(F.col("_a").isNull(), "MISSING").when(F.col("_e").isNull(), "UNEXPECTED").when(~F.col("expected").eqNullSafe(F.col("actual")), "DIFFERENT")
    return j.withColumn("difference", what).where(F.col("difference").isNotNull()).select(key, "difference")


def nearest_rank(df: DataFrame, value: str, probabilities=(0.5, 0.95, 0.99, 1.0)) -> DataFrame:
    """(p, value, count): the value of rank ceil(p * count), exact at any size. Nulls are left out."""
    return nearest_ranks(df.select(F.lit("all").alias("_g"), F.col(value).alias("_v")), "_g", "_v", probabilities).drop("_g")


def confusion(labelled: DataFrame, alert_score: int = 30) -> DataFrame:
    """Counts and ratios of alerts (risk_score at or above alert_score) against label SUSPICIOUS; a ratio of nothing is null."""
    bad, hit = F.col("label") == "SUSPICIOUS", F.col("risk_score") >= alert_score
    c = labelled.agg(F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(fp, fp + tn).alias("false_positive_rate"))


def source_offsets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_topic", "source_partition").agg(F.max("source_offset").alias("max_offset"))


def acknowledged(acks: DataFrame) -> DataFrame:
    """(source_topic, source_partition, next_offset): where a reader of acknowledged records goes on, the
    highest one and one more; acknowledgements of several writers merge in any order."""
    top = acks.where(F.col("source_offset").isNotNull()).groupBy("source_topic", "source_partition").agg(F.max("source_offset").alias("top"))
    return top.select("source_topic", "source_partition", (F.col("top") + 1).alias("next_offset"))


def by_coordinates(archived: DataFrame, processed: DataFrame, *columns: str) -> DataFrame:
    """Records of the archive with what was made of them, by topic, partition and offset: an equality join
    on the place, which spreads any partition of the source over all tasks."""
    keys = ["source_topic", "source_partition", "source_offset"]
    return archived.join(processed.select(*keys, *columns), keys)


def evaluated_and_invalid(inputs: DataFrame, evaluated: DataFrame, invalid: DataFrame) -> DataFrame:
    """Events that exist among the evaluated and among the invalid ones: two outcomes for one input."""
    one = inputs.select("event_id").where(F.col("event_id").isNotNull()).distinct()
    return one.join(evaluated.select("event_id"), "event_id", "left_semi").join(invalid.select("event_id"), "event_id", "left_semi")


class GapError(RuntimeError):
    pass


def require_whole(records: DataFrame, committed: dict[tuple[str, int], int] | None = None) -> None:
    """Raises GapError unless a reader may begin: without committed offsets a log has to begin at 0, with them
    it must not begin behind the next record. Offsets that no record has, as of markers of
    transactions, are no gap."""
    starts = records.groupBy("source_topic", "source_partition").agg(F.min("source_offset").alias("first"))
    for r in starts.collect():  # a row per partition of the source
        at = (committed or {}).get((r.source_topic, r.source_partition), 0)
        if r.first > at:
            raise GapError(f"{r.source_topic}/{r.source_partition} begins at {r.first}, {at} is wanted")


def offset_gaps(records: DataFrame) -> DataFrame:
    """(source_topic, source_partition, after, before): stretches without any record. A window over
    each partition of the source would be one task; here it runs per block of offsets, and the
    blocks' first and last offsets are joined by a window over blocks."""
    keys, size = ["source_topic", "source_partition"], 65_536
    o = records.select(*keys, "source_offset").distinct().withColumn("_b", F.floor(F.col("source_offset") / size))
    inside = Window.partitionBy(*keys, "_b").orderBy("source_offset")
    gaps = o.select(*keys, F.lag("source_offset").over(inside).alias("after"), F.col("source_offset").alias("before"))
    ends = o.groupBy(*keys, "_b").agg(F.min("source_offset").alias("before"), F.max("source_offset").alias("_last"))
    across = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("after"), "before")
    return gaps.unionByName(across).where(F.col("before") > F.col("after") + 1)


def position_digest(records: DataFrame, block: int = 65_536) -> DataFrame:
    """(source_topic, source_partition, records, repeated, first, last, state, digest): tells whether two
    readers read the same positions, whatever the order of arrival.

    A hash tree: the sorted offsets of a block are hashed together, then the hashes of 65,536
    neighbouring blocks, three times over, so that no task lists more than a block. A partition with
    a repeated offset has state REPEATED and no digest; rows without coordinates are left out."""
    keys = ["source_topic", "source_partition"]
    o = records.where(F.col("source_offset").isNotNull()).groupBy(*keys, "source_offset").agg(F.count(F.lit(1)).alias("_n"))
    level = o.groupBy(*keys, F.expr(f"source_offset div {int(block)}").alias("_b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("source_offset")).cast("array<string>"), "\n"), 256).alias("_h"),
        F.count(F.lit(1)).alias("records"), F.sum(F.col("_n") - 1).alias("repeated"), F.min("source_offset").alias("first"), F.max("source_offset").alias("last"),
    )
    for _ in range(3):
        below = F.sort_array(F.collect_list(F.struct("_b", "_h")))
        level = level.groupBy(*keys, F.expr("_b div 65536").alias("_up")).agg(
            F.sha2(F.array_join(F.transform(below, lambda x: x["_h"]), "\n"), 256).alias("_h"),
            F.sum("records").alias("records"), F.sum("repeated").alias("repeated"), F.min("first").alias("first"), F.max("last").alias("last"),
        ).withColumnRenamed("_up", "_b")
    state = F.when(F.col("repeated") > 0, "REPEATED").otherwise("WHOLE")
    return level.select(*keys, "records", "repeated", "first", "last", state.alias("state"), F.when(F.col("repeated") == 0, F.col("_h")).alias("digest"))


LEGS = {"producer_to_result": ("done", "sent"), "result_to_storage": ("stored", "done"), "producer_to_storage": ("stored", "sent")}


def leg_percentiles(payments: DataFrame, evaluations: DataFrame, p: float = 0.95) -> DataFrame:
    """(leg, value, count): the exact p-th percentile in ms of the ways from producer to result, from
    result to storage and from producer to storage, over first deliveries of both sides."""
    return nearest_ranks(_legs(payments, evaluations, LEGS), "leg", "ms", [p]).drop("p")


def leg_report(payments: DataFrame, evaluations: DataFrame, probabilities=(0.5, 0.95, 0.99)) -> DataFrame:
    """(leg, p, value, count): the same of several percentiles, with the way from the producer to its
    acknowledgement by the source."""
    return nearest_ranks(_legs(payments, evaluations, {"producer_to_source": ("acknowledged", "sent"), **LEGS}), "leg", "ms", probabilities)


def _legs(payments: DataFrame, evaluations: DataFrame, legs: dict[str, tuple[str, str]]) -> DataFrame:
    took = [F.min("producer_time").alias("sent")]
    if any("acknowledged" in x for x in legs.values()):
        took.append(F.min("source_timestamp").alias("acknowledged"))
    sent = payments.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(*took)
    stored = F.unix_millis(F.col("ingested_at").cast("timestamp"))
    done = evaluations.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("processed_at").alias("done"), F.min(stored).alias("stored"))
    one = F.array(*[F.struct(F.lit(k).alias("leg"), F.try_subtract(b, a).alias("ms")) for k, (b, a) in legs.items()])
    return sent.join(done, "event_id").select(F.explode(one).alias("x")).select("x.leg", "x.ms").where(F.col("ms").isNotNull())


def whole_customers(customers: DataFrame, most: int = 1_000) -> DataFrame:
    """(customer_id, payments): the first customers by id whose payments together are at most
    `most`, none in part: the customers of a bounded export. A customer has a payment at least, so
    that the running sum needs `most` rows only, which is the top of a sort."""
    top = customers.where(F.col("payments") > 0).select("customer_id", "payments").orderBy("customer_id").limit(most)
    running = F.sum("payments").over(Window.partitionBy(F.lit(0)).orderBy("customer_id").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("_sum", running).where(F.col("_sum") <= most).drop("_sum")


def export(decisions: DataFrame, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(decisions, policies) of a bounded export: the decisions of whole customers, each with the hash of its
    policy's snapshot instead of the text, and every snapshot once."""
    per = decisions.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count(F.lit(1)).alias("payments"))
    chosen = decisions.join(if_small(whole_customers(per, most).select("customer_id")), "customer_id", "left_semi")
    hashed = chosen.withColumn("policy_hash", F.when(F.col("policy_snapshot") != "", F.sha2("policy_snapshot", 256)))
    policies = hashed.where(F.col("policy_hash").isNotNull()).groupBy("policy_hash").agg(F.min("policy_snapshot").alias("policy_snapshot"), F.count(F.lit(1)).alias("decisions"))
    return hashed.drop("policy_snapshot"), policies


def gate(conflicts: DataFrame, rejections: DataFrame) -> DataFrame:
    """(unresolved, conflicts, rejections): what keeps results from being served, counted in one plan."""
    both = conflicts.select(F.lit("c").alias("k")).unionByName(rejections.select(F.lit("r").alias("k")))
    return both.agg(F.count(F.lit(1)).alias("unresolved"), F.count_if(F.col("k") == "c").alias("conflicts"), F.count_if(F.col("k") == "r").alias("rejections"))

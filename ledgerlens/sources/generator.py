"""Seeded payments for load tests, made where they are needed: every value is a hash of the seed
and the row's number, so that executors generate in parallel and a lost task repeats itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = ("ordinary", "burst", "many-devices", "new-device")


@dataclass(frozen=True)
class GeneratorConfig:
    seed: int = 7
    customers: int = 40
    per_customer: int = 8
    retry_percent: int = 10
    start_ms: int = 1_704_067_200_000
    span_ms: int = 86_400_000
    weights: tuple[int, ...] = (70, 10, 10, 10)
    hot_percent: int = 0  # share of the first customer
    late_percent: int = 0  # share of payments that arrive three to six hours after they happened
    shuffled_ms: int = 0  # arrival differs from the order of event times by up to so much
    malformed_percent: int = 0  # share of payments that lack a field or have one out of range

    def __post_init__(self) -> None:
        good = 1 <= self.customers <= 10_000_000 and 1 <= self.per_customer <= 100_000 and 0 <= self.retry_percent <= 50 and 0 <= self.hot_percent <= 90 and self.span_ms > 0 and self.start_ms > 0
        good = good and all(0 <= x <= 100 for x in (self.late_percent, self.malformed_percent)) and self.shuffled_ms >= 0
        if not good or len(self.weights) != len(PROFILES) or min(self.weights) < 0 or sum(self.weights) != 100:
            raise ValueError("invalid generator settings")


# Loads to test with, by name
SCENARIOS = {
    "steady": GeneratorConfig(retry_percent=0, weights=(100, 0, 0, 0)),
    "burst": GeneratorConfig(weights=(0, 100, 0, 0)),
    "hot-key": GeneratorConfig(hot_percent=33),
    "high-cardinality": GeneratorConfig(customers=2_000, per_customer=1),
    "duplicates": GeneratorConfig(retry_percent=50),
    "out-of-order": GeneratorConfig(shuffled_ms=600_000),
    "late": GeneratorConfig(late_percent=20),
    "malformed": GeneratorConfig(malformed_percent=20),
}


def payments(spark: SparkSession, c: GeneratorConfig) -> DataFrame:
    """Deliveries: transactions with coordinates; a retry has its payment's event_id at a later offset."""
    rows = c.customers * c.per_customer
    draw = lambda what, top: F.pmod(F.xxhash64(F.lit(c.seed), F.lit(what), F.col("id")), F.lit(top))
    of = lambda what, key, top: F.pmod(F.xxhash64(F.lit(c.seed), F.lit(what), key), F.lit(top))
    customer = F.when(draw("hot", 100) < c.hot_percent, F.lit(0)).otherwise(F.col("id") % c.customers)
    base = spark.range(rows).withColumn("c", customer)
    lot, profile = of("profile", F.col("c"), 100), F.lit(PROFILES[-1])
    edge = 100
    for name, w in reversed(list(zip(PROFILES, c.weights))):
        profile = F.when(lot < edge, F.lit(name)).otherwise(profile)
        edge -= w
    base = base.withColumn("profile", profile)
    home = of("home", F.col("c"), c.span_ms)
    time: Column = F.when(F.col("profile") == "burst", F.pmod(home + draw("t", 600_000), F.lit(c.span_ms))).otherwise(draw("t", c.span_ms)) + c.start_ms
    device = F.when(F.col("profile") == "many-devices", draw("d", 50)).when((F.col("profile") == "new-device") & (draw("d", 4) == 0), draw("d", 1000)).otherwise(F.lit(0))
    tx = base.select(
        "id",
        F.format_string("evt-%d", "id").alias("event_id"), F.format_string("txn-%d", "id").alias("transaction_id"), F.format_string("cust-%d", "c").alias("customer_id"),
        F.format_string("merchant-%d", draw("m", 50)).alias("merchant_id"), (draw("a", 120_000) + 1).alias("amount_minor"), F.lit("EUR").alias("currency"), F.lit("IT").alias("country"),
        F.format_string("dev-%d-%d", "c", device).alias("device_id"), F.when(draw("s", 10) < 2, "DECLINED").otherwise("APPROVED").alias("status"), time.alias("event_time"), (time + draw("p", 2_000)).alias("producer_time"),
    )
    if c.late_percent or c.shuffled_ms:
        held = draw("j", c.shuffled_ms + 1) + F.when(draw("late", 100) < c.late_percent, 10_800_000 + draw("l", 10_800_000)).otherwise(F.lit(0))
        tx = tx.withColumn("producer_time", F.col("producer_time") + held)
    if c.malformed_percent:
        broken, kind = draw("bad", 100) < c.malformed_percent, draw("kind", 4)
        for k, (f, v) in enumerate((("customer_id", F.lit(" ")), ("amount_minor", F.lit(0).cast("bigint")), ("currency", F.lit("eur")), ("country", F.lit("XX")))):
            tx = tx.withColumn(f, F.when(broken & (kind == k), v).otherwise(F.col(f)))
    copies = tx.withColumn("_copy", F.explode(F.when(draw("r", 100) < c.retry_percent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select(
        *[x for x in tx.columns if x != "id"],
        F.lit("payments.raw").alias("source_topic"), (F.col("id") % 3).cast("int").alias("source_partition"), (F.floor(F.col("id") / 3) + F.col("_copy") * rows).alias("source_offset"), (F.col("producer_time") + 5 + F.col("_copy") * 60_000).alias("source_timestamp"),
    )


_STORY = "name string, label string, payments array<struct<seconds:bigint,amount_minor:bigint,device:string,merchant:string,status:string>>"


def _story(name: str, label: str, *payments: tuple[int, int, str, str]) -> tuple:
    return name, label, [(s, a, d, "merchant-1", status) for s, a, d, status in payments]


OK, NO = "APPROVED", "DECLINED"
STORIES = (
    _story("everyday", "LEGITIMATE", (-172_800, 1_250, "phone", OK), (-86_400, 3_475, "phone", OK), (0, 2_160, "phone", OK)),
    _story("known-device-large", "LEGITIMATE", (-7_200, 2_500, "phone", OK), (0, 96_000, "phone", OK)),
    _story("new-phone", "LEGITIMATE", (-7_200, 2_500, "phone", OK), (0, 96_000, "new-phone", OK)),
    _story("account-takeover", "SUSPICIOUS", *[(-108 + 18 * i, 91_000, f"bot-{i}", NO if i < 5 else OK) for i in range(7)]),
    _story("card-testing", "SUSPICIOUS", *[(-300 + 60 * i, 100, "laptop", NO if i < 5 else OK) for i in range(6)]),
    _story("multiple-devices", "SUSPICIOUS", *[(-360 + 120 * i, 92_000, f"device-{i}", OK) for i in range(4)]),
    _story("small-payment-burst", "SUSPICIOUS", *[(-90 + 15 * i, 400, "phone", OK) for i in range(7)]),
    _story("stolen-trusted-device", "SUSPICIOUS", (-7_200, 1_900, "phone", OK), (0, 64_000, "phone", OK)),
    _story("legitimate-retry", "LEGITIMATE", (-40, 5_900, "phone", NO), (-20, 5_900, "phone", NO), (0, 5_900, "phone", OK)),
)


def stories(spark: SparkSession, path: str | None, end_ms: int) -> DataFrame:
    """Authored stories (name, label, payments[seconds, amount_minor, device, merchant, status]) as
    payments before end_ms; `target` marks the last one of each, which the label is about. Those of
    this module if there is no path to a JSON file of others."""
    s = spark.read.option("multiLine", True).json(path) if path else spark.createDataFrame(list(STORIES), _STORY)
    p = s.select("name", "label", F.size("payments").alias("_n"), F.posexplode("payments").alias("i", "p"))
    t = (F.lit(end_ms) + F.col("p.seconds") * 1000).cast("bigint")
    return p.select(
        F.concat_ws("-", F.lit("evt"), "name", F.col("i").cast("string")).alias("event_id"), F.concat_ws("-", F.lit("txn"), "name", F.col("i").cast("string")).alias("transaction_id"), F.concat_ws("-", F.lit("cust"), "name").alias("customer_id"),
        F.col("p.merchant").alias("merchant_id"), F.col("p.amount_minor").cast("bigint").alias("amount_minor"), F.lit("EUR").alias("currency"), F.lit("IT").alias("country"), F.col("p.device").alias("device_id"), F.col("p.status").alias("status"),
        t.alias("event_time"), t.alias("producer_time"), "label", (F.col("i") == F.col("_n") - 1).alias("target"),
    )

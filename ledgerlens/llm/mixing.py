"""Records of several sources mixed to target shares of the total size.

T, the size of the mixture, is the size of all records of the listed sources. A source is
used rate = share * T / size times, at most max_repeats times; every record gets the whole
part of the rate as copies, and the fractional part is a sample drawn by the cube method:
inclusion probabilities move through the null-space of two constraints, the number of tokens
and the number of records, until all but two units of a random group are settled. What the
groups leave is pooled and moves on, group of groups by group of groups; the last two units
of a source land by giving up first the tokens, then the count. Probabilities are kept in
expectation throughout, and the sample of a source misses its size by at most two records.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.packing import placed, random_group
from ledgerlens.llm.tokens import VOCABULARY, token_count
from ledgerlens.session import if_small, materialize

GROUP_ROWS = 8192
SEED = 20_250_302
_EPS = 1e-9


def flight(pi: np.ndarray, tokens: np.ndarray, rng: random.Random, land: bool = False) -> np.ndarray:
    """Moves probabilities until at most two are fractional; none if land. All units weigh
    alike at the start, so that a step along (t1 - t2, t2 - t0, t0 - t1) keeps the sums of
    probabilities and of tokens."""
    p, t = pi.tolist(), tokens.tolist()
    order = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    rng.shuffle(order)
    live: list[int] = []

    def step(who: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(who, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(who, u) if x)
        move = up if rng.random() * (up + down) < down else -down
        for i, x in zip(who, u):
            p[i] += move * x
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
        live[:] = [i for i in live if 0 < p[i] < 1]

    for i in order:
        live.append(i)
        if len(live) == 3:
            a, b, c = live
            u = [t[b] - t[c], t[c] - t[a], t[a] - t[b]]
            step([a, b, c], u if any(u) else [1, -1, 0])
    if land:
        while len(live) > 1:
            step(live[:2], [1, -1])
        for i in live:
            p[i] = 1.0 if rng.random() < p[i] else 0.0
    return np.array(p)


def _fly(seed: int, land: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["doc_id", "tokens", "row"], kind="stable")  # whatever order the rows came in
        rng = random.Random(f"{seed} {units['source'].iloc[0]} {units['grp'].iloc[0]}")
        return units.assign(pi=flight(units["pi"].to_numpy(float), units["tokens"].to_numpy(float), rng, land))

    return run


class Mixture:
    """plan: source, target_share, max_repeats, records, size, rate, short; records: source,
    doc_id, tokens, copies (only those used).

    Records of unlisted or null sources take no part. A listed source without records, or with
    tokens 0 in all, is short if its share is above 0. Null or negative shares count as 0, null
    or negative max_repeats as 0; of a source listed twice, the larger share counts."""

    def __init__(self, documents: DataFrame, targets: DataFrame, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY, seed: int = SEED):
        t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
        mine = placed(documents.where(F.col("source").isNotNull()), "source", "doc_id", "text").join(if_small(t.select("source")), "source", "left_semi")
        sized = mine.select("source", "doc_id", token_count(F.col("text"), vocabulary).alias("tokens"), "row")
        sized = materialize(sized, "sized")
        sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("size"), F.max("tokens").alias("longest"))
        plan = t.join(sums, "source", "left").na.fill(0, ["records", "size", "longest"])
        # windows over all rows below run over tables of one row per source
        plan = plan.withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(0))))
        want = F.col("target_share") * F.col("total")
        plan = plan.withColumn("short", F.col("size") * F.col("max_repeats") < want)
        self.plan = materialize(plan.withColumn("rate", F.when(F.col("size") > 0, F.least(want / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))), "plan")
        # each source has as many groups as its records need; levels until one group per source is left
        rated = sized.join(if_small(self.plan.select("source", "rate", F.greatest(F.lit(1), F.ceil(F.col("records") / group_rows)).cast("int").alias("groups"))), "source")
        units = rated.select("source", "doc_id", "tokens", "row", random_group(F.col("groups"), seed, "source", "doc_id", "row").alias("grp"), "groups", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("pi"))
        schema = units.schema
        most = max(1, -(-(self.plan.agg(F.max("records")).first()[0] or 0) // group_rows))
        settled, level = [], 0
        while True:
            last = most == 1
            flown = units.groupBy("source", "grp").applyInPandas(_fly(seed + level, last), schema)
            if last:
                settled.append(flown)
                break
            flown = materialize(flown, f"flight{level}")
            done = (F.col("pi") <= 0) | (F.col("pi") >= 1)
            settled.append(flown.where(done))
            most, level = -(-most * 2 // group_rows), level + 1
            fewer = F.ceil(F.col("groups") * 2 / group_rows).cast("int")
            units = flown.where(~done).withColumn("grp", F.pmod("grp", fewer).cast("int")).withColumn("groups", fewer)
        every = settled[0]
        for s in settled[1:]:
            every = every.unionByName(s)
        self.records = every.select("source", "doc_id", "tokens", (F.col("whole") + F.round("pi").cast("int")).alias("copies")).where(F.col("copies") > 0)

    def report(self) -> DataFrame:
        """Per listed source its target and actual share, the records and copies used, and
        whether it is short: cannot reach its share within max_repeats."""
        used = self.records.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most"))
        r = self.plan.join(used, "source", "left").na.fill(0, ["used", "copies", "mixed", "most"])
        r = r.withColumn("whole", F.sum("mixed").over(Window.partitionBy(F.lit(0))))
        # a short source has every copy it may have, and what is mixed falls below its target
        short = F.col("short") & (F.col("mixed") < F.col("target_share") * F.col("total"))
        return r.select("source", "target_share", "max_repeats", "records", "size", "used", "copies", "most", "mixed", F.try_divide(F.col("mixed"), F.col("whole")).alias("actual_share"), short.alias("short"))

    def invariants(self) -> DataFrame:
        """Per listed source: records, most (whether a record is used more than max_repeats times), short,
        and off: whether the tokens mixed differ from share * T, or, of a source that is short, from all it may
        give, by more than two of its longest records."""
        r = self.report().join(self.plan.select("source", "longest"), "source", "left")
        want = F.when(F.col("short"), F.col("size") * F.col("max_repeats")).otherwise(F.col("target_share") * F.sum("size").over(Window.partitionBy(F.lit(0))))
        off = F.abs(F.col("mixed") - want) > 2 * F.col("longest")
        return r.select("source", "target_share", "records", (F.col("most") > F.col("max_repeats")).alias("over"), off.alias("off"), "short")

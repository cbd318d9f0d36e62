"""Attributes as known at event time, by bitemporal rectangles.

A version of an entity's attributes applies from `valid_from` on and is known from
`known_from` on. Over the plane of valid and recorded time, each version covers the quadrant
above its two times and the highest version that covers a point is current there.
version_rectangles splits the plane into disjoint rectangles with one current version each;
index_rectangles registers them in the cells of a grid; locate finds for each event the
rectangles that hold its point, by an equality join on (entity, cell) and a range check. What
became known later cannot be met, as its rectangle starts after the event's point.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.evaluations import kept_copies
from ledgerlens.session import if_small, materialize

FOREVER = (1 << 63) - 1
CELLS, MOST_CELLS = 32, 512


class Staircase:
    """The union of quadrants: corners by ascending x and descending y."""

    def __init__(self) -> None:
        self.x: list[int] = []
        self.y: list[int] = []

    def add(self, x: int, y: int) -> list[tuple[int, int, int, int]]:
        """Adds the quadrant above (x, y); returns its part outside the union so far as
        rectangles (x0, x1, y0, y1), half open. Each corner is removed at most once, so n
        quadrants give at most 2n rectangles."""
        i = bisect_right(self.x, x)
        roof = self.y[i - 1] if i else FOREVER
        if roof <= y:
            return []
        out, left, j = [], x, i
        while roof > y:
            right = self.x[j] if j < len(self.x) else FOREVER
            if right > left:
                out.append((left, right, y, roof))
            if j == len(self.x):
                break
            left, roof = right, self.y[j]
            j += 1
        # corners above and right of the new one have become part of its quadrant
        lo = i - 1 if i and self.x[i - 1] == x else i
        hi = lo
        while hi < len(self.x) and self.y[hi] >= y:
            hi += 1
        self.x[lo:hi], self.y[lo:hi] = [x], [y]
        return out


def version_rectangles(versions: DataFrame, keys: Sequence[str], version: str, valid_from: Column, known_from: Column) -> DataFrame:
    """(keys..., version, valid_from, valid_to, known_from, known_to), bigint and half open.

    Versions of an entity pass through one task in descending order; it keeps the outline of
    the union only. Repeated rows add what their own times cover, so that of equal copies the
    first counts. Rows with a null key, version or time are never current."""
    keys = list(keys)
    rows = versions.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.col(version).cast("bigint").alias("v"), valid_from.cast("bigint").alias("x"), known_from.cast("bigint").alias("y")).dropna()
    ks = [f"k{i}" for i in range(len(keys))]

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, stairs = None, Staircase()
        for f in frames:
            out = []
            for *k, v, x, y in f.itertuples(index=False, name=None):
                if k != entity:
                    entity, stairs = k, Staircase()
                out += [(*k, v, *r) for r in stairs.add(x, y)]
            yield pd.DataFrame(out, columns=[*ks, "v", "x0", "x1", "y0", "y1"])

    ordered = rows.repartition(*ks).sortWithinPartitions(*ks, F.desc("v"), "x", "y")
    cut = ordered.mapInPandas(split, ", ".join([f"{k} string" for k in ks] + [f"{c} bigint" for c in ("v", "x0", "x1", "y0", "y1")]))
    return cut.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], F.col("v").alias("version"), F.col("x0").alias("valid_from"), F.col("x1").alias("valid_to"), F.col("y0").alias("known_from"), F.col("y1").alias("known_to"))


class Grid:
    """side x side cells over the span of the versions' times; the outer cells reach to infinity.
    The side follows the number of rectangles, so that a cell stays thin when an entity has
    many versions.

    The span and the number are one row, read once: the only thing an index sends to the driver."""

    def __init__(self, rectangles: DataFrame, keys: Sequence[str]):
        per = rectangles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("valid_from", "known_from") for f in (F.min, F.max)])
        low = per.agg(F.max("n"), F.min("min_valid_from"), F.max("max_valid_from"), F.min("min_known_from"), F.max("max_known_from")).first()
        n, x0, x1, y0, y1 = (v or 0 for v in low)
        self.side = min(max(CELLS, math.isqrt(n)), MOST_CELLS)
        self.x0, self.xw, self.y0, self.yw = x0, max(1, (x1 - x0) // self.side + 1), y0, max(1, (y1 - y0) // self.side + 1)

    def _cell(self, c: Column, lo: int, width: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.side - 1), F.floor(F.try_subtract(c, F.lit(lo)) / F.lit(width)))).cast("int")

    def x(self, c: Column) -> Column:
        return self._cell(c, self.x0, self.xw)

    def y(self, c: Column) -> Column:
        return self._cell(c, self.y0, self.yw)


def locate(events: DataFrame, rectangles: DataFrame, keys: Sequence[str], valid_at: str | Column, known_at: str | Column, how: str = "inner") -> DataFrame:
    """events with the columns of the rectangle that holds their point (valid_at, known_at): one
    row for each attribute key of the rectangles that the events lack. Events without a version
    at their point, or with a null key or time, have no row, or one without version if how is 'left'.

    keys: the columns of the rectangles to be met by equal columns of the events. A grid index
    that is not small is not broadcast but joined by exchange on (keys, cell), where a hot
    entity is split by its cells and by AQE. rectangles are read twice: they should be a table."""
    keys = list(keys)
    grid = Grid(rectangles, keys)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (valid_at, known_at))
    cells = rectangles.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in rectangles.columns if c not in keys],
        F.explode(F.sequence(grid.x(F.col("valid_from")), grid.x(F.col("valid_to") - 1))).alias("_cx"),
    ).withColumn("_cy", F.explode(F.sequence(grid.y(F.col("known_from")), grid.y(F.col("known_to") - 1))))
    points = events.withColumns({"_x": x, "_y": y, "_px": grid.x(x), "_py": grid.y(y)})
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    inside = (F.col("_x") >= F.col("valid_from")) & (F.col("_x") < F.col("valid_to")) & (F.col("_y") >= F.col("known_from")) & (F.col("_y") < F.col("known_to"))
    found = points.join(if_small(cells), on & inside, how)
    return found.drop("_x", "_y", "_px", "_py", "_cx", "_cy", *[f"_k{i}" for i in range(len(keys))])


def rules_at_event_time(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """(evaluation_id, rule_id, version, implied): for each logical evaluation and rule of its
    policy, the version usable at its event time and the one its policy_version implies (null
    if it implies none)."""
    kept = kept_copies(evaluations, "policy_id", "policy_version", "event_time")
    entity = ["policy_id", "rule_id"]
    known = materialize(version_rectangles(rules, entity, "version", F.col("updated_at"), F.col("source_timestamp")), "rectangles")
    right = locate(kept, known, ["policy_id"], "event_time", "event_time").select("evaluation_id", *entity, "policy_version", "version")
    # the versions a policy version came with: rectangles with policy versions as valid time, all known at once
    came = materialize(version_rectangles(rules, entity, "version", F.col("policy_version"), F.lit(0)), "implied").withColumnRenamed("version", "implied")
    return locate(right, came, entity, "policy_version", F.lit(0), "left").select("evaluation_id", "rule_id", "version", "implied")


def other_version_than_implied(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    found = rules_at_event_time(evaluations, rules)
    return found.where(~F.col("version").eqNullSafe(F.col("implied"))).select("evaluation_id", "rule_id", "version")

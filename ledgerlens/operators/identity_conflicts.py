"""De-duplication by identity, with the conflicts it would hide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each non-null key that comes first in `order`, with `copies` and `variants`,
    the number of different contents (all columns but those of `order`). Reduced map-side: only
    one candidate per key and task is exchanged. Content is compared by a 256-bit hash."""
    content = [c for c in df.columns if c not in order]
    rows = df.where(F.col(key).isNotNull()).select(key, F.struct(*df.columns).alias("_row"), F.struct(*order).alias("_order"), F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias("_content"))
    best = rows.groupBy(key, "_content").agg(F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order"), F.count(F.lit(1)).alias("_n"))
    one = best.groupBy(key).agg(F.min_by("_row", "_order").alias("_row"), F.sum("_n").alias("copies"), F.count(F.lit(1)).alias("variants"))
    return one.select("_row.*", "copies", "variants")


def conflicts(firsts: DataFrame, key: str) -> DataFrame:
    """Keys that were delivered with different contents."""
    return firsts.where(F.col("variants") > 1).select(key, "copies", "variants")


class IdentityConflict(RuntimeError):
    pass


def require_none(found: DataFrame, what: str) -> None:
    """Raises if there is any conflict: the strict mode of a job."""
    one = found.limit(1).collect()
    if one:
        raise IdentityConflict(f"{what}: {one[0]}")

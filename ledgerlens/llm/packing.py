"""Items of varying size in containers of fixed capacity, by first-fit decreasing.

Documents are spread over random groups of a bounded expected size, and each group is packed
on its own: longest item first, each into the first container with enough room, which a
tournament tree over the containers' free room finds in logarithmic time. Only a document
above the capacity is split: into full containers and one rest, which is an item like others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import VOCABULARY, token_count
from ledgerlens.session import if_small, materialize, spread

CAPACITY = 4096
GROUP_ROWS = 8192
SEED = 20_250_301


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items taken in the given order; every size is at most the capacity."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)  # the tree: room[i] is the most room below node i
    out = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < size:
                i += 1
        out[k] = i - leaves
        left = room[i] - size
        while True:
            room[i] = left
            if i == 1:
                break
            other = room[i ^ 1]
            i >>= 1
            if other > left:
                left = other
            if room[i] == left:
                break
    return out


def random_group(groups: int | Column, seed: int, *columns: str | Column) -> Column:
    """A group for each row by a hash of the columns, which have to tell equal rows apart for these to be spread."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), groups if isinstance(groups, Column) else F.lit(groups)).cast("int")


def placed(documents: DataFrame, *columns: str) -> DataFrame:
    """The columns of documents, spread over all cores, and `row`: 0 where the doc_id is unique, so that
    a result depends on the documents alone and not on the files they lie in. Rows of one id are told
    apart by their place in the scan, which a task that runs again repeats: documents have to be a scan
    or a written table, not the result of an exchange."""
    rows = spread(documents.select(*columns, F.monotonically_increasing_id().alias("row")))
    again = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    if again.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("bigint"))
    marked = rows.join(if_small(again), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return marked.withColumn("row", F.when(F.col("_again"), F.col("row")).otherwise(F.lit(0))).select(*columns, "row")


def _packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        tokens = items["tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-tokens // capacity))
        full = tokens // capacity * (tokens > capacity)  # a document of exactly the capacity is one whole item
        rest = tokens - full * capacity
        one = (rest > 0) | (full == 0)
        order = np.lexsort((items["doc_id"].fillna(-1).to_numpy(), -rest))
        order = order[one[order]]
        bins = first_fit(rest[order], capacity)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        rows = np.concatenate([order, np.repeat(np.arange(len(items)), full)])
        first = np.cumsum(full) - full
        piece = np.concatenate([full[order], np.arange(full.sum()) - np.repeat(first, full)])
        out = items.iloc[rows].assign(piece=piece, pieces=pieces[rows], size=np.concatenate([rest[order], np.full(full.sum(), capacity)]))
        group = out["grp"].to_numpy(np.int64)
        out["container"] = (group << 32) + np.concatenate([bins, n_bins + np.arange(full.sum())])
        return out[["doc_id", "piece", "pieces", "size", "container"]]

    return pack


def pack(documents: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, piece, pieces, size, container): where each document, or piece of one, lies.

    Null and empty texts are items of size 0 and lie in a container like others; repeated
    doc_ids are items of their own; other columns are ignored. The number of groups follows
    the number of rows (read from file footers), so that a group stays small."""
    groups = max(1, -(-documents.count() // group_rows))
    sized = placed(documents, "doc_id", "text").select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens"), random_group(groups, seed, "doc_id", "row").alias("grp"))
    return sized.groupBy("grp").applyInPandas(_packer(capacity), "doc_id bigint, piece bigint, pieces bigint, size bigint, container bigint")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, items, size, free) of each container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("size")).withColumn("free", F.lit(capacity) - F.col("size"))


def invariants(documents: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row that tells whether documents are packed whole: documents, packed (distinct ones in
    containers), split, broken (whose pieces are not numbered 0 to the last, or have not the document's
    tokens in all), overfull containers, and slack: whether more containers are half empty than one a group."""
    p = materialize(pack(documents, capacity, group_rows, vocabulary), "packed")
    per = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"), F.count_distinct("piece").alias("numbers"), F.max("piece").alias("last"), F.sum("size").alias("size"))
    own = documents.select(F.col("doc_id").alias("_d"), token_count(F.col("text"), vocabulary).alias("tokens")).groupBy("_d").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    j = own.join(per, F.col("_d").eqNullSafe(F.col("doc_id")), "left")
    whole = (F.col("size") == F.col("tokens")) & ((F.col("rows") > 1) | ((F.col("n") == F.col("pieces")) & (F.col("numbers") == F.col("n")) & (F.col("last") == F.col("n") - 1)))
    docs = j.agg(F.sum("rows").alias("documents"), F.count("n").alias("packed"), F.count_if(F.col("pieces") > 1).alias("split"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken"))
    c = containers(p, capacity).withColumn("grp", F.shiftright("container", 32))
    groups = c.groupBy("grp").agg(F.count_if(F.col("free") < 0).alias("over"), (F.count_if(F.col("free") * 2 > capacity) > 1).alias("slack"))
    bins = groups.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("overfull"), F.coalesce(F.bool_or("slack"), F.lit(False)).alias("slack"))
    return docs.withColumn("_one", F.lit(1)).join(bins.withColumn("_one", F.lit(1)), "_one").drop("_one")


def split_documents(packed: DataFrame) -> DataFrame:
    """The documents that had to be split."""
    return packed.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("doc_id")

"""Exactly one copy of every identifier, by exact quotient hash tables.

Identifiers of equal width are permuted by an invertible mixing of their words (a Feistel
network), so that any identifiers spread evenly. The leading bits of a permuted identifier
(its quotient) name the shard; the table of a shard stores the rest (the remainder)
completely, at the slot of its next bits or, if that is taken, further on. Nothing is
hashed away: two identifiers are equal if and only if quotient and remainder are, there are
no false matches, and the identifier is recovered from them by the inverse permutation.

The map side keeps a bounded table per task and passes on one entry per identifier and
flush, so that any number of copies of one identifier costs each task a few rows. Entries
are then exchanged by shard and merged; shards are sorted and processed one after another,
and their number follows the number of rows, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = np.iinfo(np.int64).max  # stands for null: null coordinates sort last
SHARD_ROWS = 262_144
FLUSH_ROWS = 131_072
HEX = -1  # the class of prefix + 64 hexadecimal digits, kept as 32 bytes
_C1, _C2, _ROUNDS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 4
_KEYS = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(_ROUNDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    place = np.arange(1, half.shape[1] + 1, dtype=np.uint64) * key
    every = _mix(half + place).sum(axis=1, dtype=np.uint64)
    return _mix(half ^ _mix(every + key)[:, None])


def permute(words: np.ndarray) -> np.ndarray:
    """An invertible mixing of rows of 64-bit words (an even number of columns)."""
    h = words.shape[1] // 2
    a, b = words[:, :h].copy(), words[:, h:].copy()
    for key in _KEYS:
        a, b = b, a ^ _round(b, key)
    return np.concatenate([a, b], axis=1)


def restore(words: np.ndarray) -> np.ndarray:
    """The inverse of permute."""
    h = words.shape[1] // 2
    a, b = words[:, :h].copy(), words[:, h:].copy()
    for key in reversed(_KEYS):
        a, b = b ^ _round(a, key), a
    return np.concatenate([a, b], axis=1)


class QuotientTable:
    """Complete remainders of one shard with, for each, the least (t, p, o) and the number of copies."""

    def __init__(self, n_words: int, shard_bits: int, room: int = 1024):
        self.m, self.shard_bits, self.filled = n_words, shard_bits, 0
        self._make(max(10, int(2 * room - 1).bit_length()))

    def _make(self, bits: int) -> None:
        self.bits, n = bits, 1 << bits
        self.used = np.zeros(n, bool)
        self.rest = np.zeros((n, self.m), np.uint64)
        self.at = np.full((n, 3), LAST, np.int64)
        self.copies = np.zeros(n, np.int64)
        self.owner = np.zeros(n, np.int64)

    def _grow(self, more: int) -> None:
        if 2 * (self.filled + more) <= 1 << self.bits:
            return
        u = self.used
        old = self.rest[u], self.at[u], self.copies[u]
        self._make(int(2 * (self.filled + more)).bit_length())
        self.filled = 0
        self._put(*old)

    def add(self, rest: np.ndarray, at: np.ndarray, copies: np.ndarray) -> None:
        self._grow(len(rest))
        self._put(rest, at, copies)

    def _put(self, rest: np.ndarray, at: np.ndarray, copies: np.ndarray) -> None:
        n = len(rest)
        first = rest[:, 0] << np.uint64(self.shard_bits) if self.shard_bits else rest[:, 0]
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        mask, wait = (1 << self.bits) - 1, np.arange(n)
        while len(wait):
            s = slot[wait]
            free = ~self.used[s]
            if free.any():
                who, where = wait[free], s[free]
                self.owner[where] = who  # one of several that want a slot gets it
                won = self.owner[where] == who
                who, where = who[won], where[won]
                self.used[where], self.rest[where] = True, rest[who]
                self.filled += len(who)
            other = (self.rest[s] != rest[wait]).any(axis=1)
            wait = wait[other]
            slot[wait] = (slot[wait] + 1) & mask
        np.add.at(self.copies, slot, copies)
        order = np.lexsort((at[:, 2], at[:, 1], at[:, 0], slot))
        lead = order[np.r_[True, slot[order][1:] != slot[order][:-1]]] if n else order
        s, new, old = slot[lead], at[lead], self.at[slot[lead]]
        less = (new[:, 0] < old[:, 0]) | ((new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | ((new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))))
        self.at[s[less]] = new[less]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.rest[self.used], self.at[self.used], self.copies[self.used]


def _bytes(a: pa.Array, width: int) -> np.ndarray:
    """The values of a binary array, all `width` bytes long, as a matrix of bytes."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(len(a), width) if width else np.zeros((len(a), 0), np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _words(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    padded = np.zeros((n, max(16, -(-width // 16) * 16)), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def _columns(b: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([b.column(c).fill_null(LAST).to_numpy(zero_copy_only=False) for c in names], axis=1)


def _collapse(shard_bits: int):
    """Map side: identifiers to (class, shard, permuted key, least coordinates, copies)."""

    def emit(tables: dict[int, QuotientTable]) -> Iterator[pa.RecordBatch]:
        for kind, table in tables.items():
            rest, at, copies = table.rows()
            for i in range(0, len(rest), 8192):
                r, a = rest[i : i + 8192], at[i : i + 8192]
                shard = (r[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int32) if shard_bits else np.zeros(len(r), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), kind, np.int32)), pa.array(shard), _binary(r.astype(">u8").view(np.uint8).reshape(len(r), -1)), *[pa.array(a[:, j]) for j in range(3)], pa.array(copies[i : i + 8192])],
                    names=["kind", "shard", "key", "t", "p", "o", "copies"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, QuotientTable] = {}
        for b in batches:
            kinds, at = b.column("kind").to_numpy(), _columns(b, "t", "p", "o")
            for kind in np.unique(kinds):
                mine = kinds == kind
                key = b.column("key") if mine.all() else b.column("key").filter(pa.array(mine))
                words = permute(_words(_bytes(key, 32 if kind == HEX else int(kind))))
                table = tables.setdefault(int(kind), QuotientTable(words.shape[1], 0))
                table.add(words, at[mine], np.ones(len(words), np.int64))
            if sum(t.filled for t in tables.values()) > FLUSH_ROWS:
                yield from emit(tables)
                tables = {}
        yield from emit(tables)

    return run


def _merge(shard_bits: int, prefix: str):
    """Reduce side: one table per shard and class, emitted when the next shard begins."""

    def emit(tables: dict[int, QuotientTable]) -> Iterator[pa.RecordBatch]:
        for kind, table in tables.items():
            rest, at, copies = table.rows()
            for i in range(0, len(rest), 8192):
                a = at[i : i + 8192]
                raw = restore(rest[i : i + 8192]).astype(">u8").view(np.uint8).reshape(len(a), -1)
                if kind == HEX:
                    text = raw.tobytes().hex()
                    ids = pa.array([prefix + text[k : k + 64] for k in range(0, len(text), 64)], pa.string())
                else:
                    ids = _binary(raw[:, :kind]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(a[:, j], mask=a[:, j] == LAST) for j in range(3)], pa.array(copies[i : i + 8192])], names=["id", "t", "p", "o", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, now = {}, -1
        for b in batches:
            kinds, shards, at, copies = b.column("kind").to_numpy(), b.column("shard").to_numpy(), _columns(b, "t", "p", "o"), b.column("copies").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(shards) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if shards[lo] != now:
                    yield from emit(tables)
                    tables, now = {}, shards[lo]
                for kind in np.unique(kinds[lo:hi]):
                    mine = np.flatnonzero(kinds[lo:hi] == kind) + lo
                    width = 32 if kind == HEX else int(kind)
                    key = _bytes(b.column("key").take(pa.array(mine)), max(16, -(-width // 16) * 16))
                    rest = key.copy().view(">u8").astype(np.uint64)
                    tables.setdefault(int(kind), QuotientTable(rest.shape[1], shard_bits)).add(rest, at[mine], copies[mine])
        yield from emit(tables)

    return run


def one_of_each(deliveries: DataFrame, id_column: str = "evaluation_id", prefix: str = "eval_", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, ingested_at, source_partition, source_offset, copies) of every identifier: the least
    coordinates, whatever the copies contain. Identifiers of any form and length are exact; null
    and empty ones are left out; null coordinates come after all others; extra columns are ignored."""
    spark = deliveries.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-deliveries.count() // shard_rows))  # the count comes from file footers
    shard_bits = (shards - 1).bit_length() + 1
    ident = F.col(id_column)
    is_hex = ident.rlike(f"^{prefix}[0-9a-f]{{64}}\\z")
    rows = deliveries.where(ident != "").select(
        F.when(is_hex, F.lit(HEX)).otherwise(F.octet_length(ident)).cast("int").alias("kind"),
        F.when(is_hex, F.unhex(F.substring(ident, len(prefix) + 1, 64))).otherwise(F.encode(ident, "utf-8")).alias("key"),
        F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("t"),
        F.col("source_partition").cast("bigint").alias("p"),
        F.col("source_offset").cast("bigint").alias("o"),
    )
    parts = rows.mapInArrow(_collapse(shard_bits), "kind int, shard int, key binary, t bigint, p bigint, o bigint, copies bigint")
    sharded = parts.repartition("shard").sortWithinPartitions("shard")
    merged = sharded.mapInArrow(_merge(shard_bits, prefix), "id string, t bigint, p bigint, o bigint, copies bigint")
    return merged.select(F.col("id").alias(id_column), F.timestamp_micros("t").alias("ingested_at"), F.col("p").cast("int").alias("source_partition"), F.col("o").alias("source_offset"), "copies")


def repeated(deliveries: DataFrame) -> DataFrame:
    """The identifiers delivered more than once, with the coordinates of the kept copy."""
    return one_of_each(deliveries).where(F.col("copies") > 1).select("evaluation_id", "source_partition", "source_offset")

"""Binary record bodies: a decoder and an encoder for the record schemas of the topics.

A payload is a zero byte, a four-byte schema id and a body in the binary encoding of Avro. The
schema that wrote it is looked up by its id among `writers`; fields the reader knows and the writer
did not have the reader's default, fields only the writer has are passed over. Types: string, long,
int, boolean, enum, record, array and the union of null and one of them; others are refused.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


class SchemaError(ValueError):
    pass


def record(name: str, fields: T.StructType, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The schema of a struct type, as a writer of records of that type registers it."""

    def kind(t: T.DataType) -> Any:
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": kind(t.elementType)}
        if isinstance(t, T.StructType):
            return record(f"{name}_item", t)
        return next(k for k, v in _NAMES.items() if v == t)

    return {"type": "record", "name": name, "fields": [{"name": f.name, "type": kind(f.dataType)} | ({"default": defaults[f.name]} if defaults and f.name in defaults else {}) for f in fields]}


def _long(b: bytes, i: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        c = b[i]
        n |= (c & 0x7F) << shift
        i += 1
        if c < 0x80:
            break
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")
    return (n >> 1) ^ -(n & 1), i


Reader = Callable[[bytes, int], tuple[Any, int]]


def reader(schema: Any) -> Reader:
    """A function from (bytes, position) to (value, next position)."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, list):
        parts = [None if p == "null" else reader(p) for p in schema]

        def union(b: bytes, i: int) -> tuple[Any, int]:
            n, i = _long(b, i)
            if not 0 <= n < len(parts):
                raise ValueError("no such branch of a union")
            part = parts[n]
            return part(b, i) if part else (None, i)

        return union
    if isinstance(kind, dict | list):
        return reader(kind)
    if kind in ("long", "int"):
        return _long
    if kind == "boolean":

        def boolean(b: bytes, i: int) -> tuple[Any, int]:
            if b[i] > 1:
                raise ValueError("no boolean")
            return b[i] == 1, i + 1

        return boolean
    if kind == "string":

        def string(b: bytes, i: int) -> tuple[Any, int]:
            n, i = _long(b, i)
            if n < 0 or i + n > len(b):
                raise ValueError("a text ends behind the record")
            return b[i : i + n].decode(), i + n

        return string
    if kind == "enum":
        symbols = schema["symbols"]

        def enum(b: bytes, i: int) -> tuple[Any, int]:
            n, i = _long(b, i)
            if not 0 <= n < len(symbols):
                raise ValueError("no such symbol")
            return symbols[n], i

        return enum
    if kind == "array":
        item = reader(schema["items"])

        def array(b: bytes, i: int) -> tuple[Any, int]:
            out: list[Any] = []
            while True:
                n, i = _long(b, i)
                if n == 0:
                    return out, i
                if n < 0:  # a block with its size in bytes
                    _, i = _long(b, i)
                    n = -n
                if n > len(b):
                    raise ValueError("an array is longer than its record")
                for _ in range(n):
                    x, i = item(b, i)
                    out.append(x)

        return array
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]

        def rec(b: bytes, i: int) -> tuple[Any, int]:
            out = {}
            for name, read in fields:
                out[name], i = read(b, i)
            return out, i

        return rec
    raise SchemaError(f"type {kind} is not among those of the topics")


def decode(payload: bytes | None, readers: Mapping[int, Reader], defaults: Mapping[str, Any]) -> tuple[dict[str, Any] | None, str | None]:
    """(record, error code) of a payload; one of them is None."""
    if payload is None or len(payload) < 5 or payload[0] != 0:
        return None, "DESERIALIZATION_ERROR"
    ident = struct.unpack(">i", payload[1:5])[0]
    if ident not in readers:
        return None, "SCHEMA_ERROR"
    try:
        value, end = readers[ident](payload, 5)
    except (ValueError, IndexError):
        return None, "DESERIALIZATION_ERROR"
    if end != len(payload) or not isinstance(value, dict):
        return None, "DESERIALIZATION_ERROR"
    return {**defaults, **value}, None


def decoded(payload: Column, writers: Mapping[int, Any], schema: T.StructType, defaults: Mapping[str, Any] | None = None) -> Column:
    """A struct of the fields of `schema` and decode_error. writers: schemas, as JSON or parsed, by id."""
    parsed = {k: json.loads(w) if isinstance(w, str) else w for k, w in writers.items()}
    for w in parsed.values():
        reader(w)  # refuses unknown types on the driver
    names, missing = schema.names, dict(defaults or {})
    out = T.StructType([*schema.fields, T.StructField("decode_error", T.StringType())])

    @F.pandas_udf(out)  # type: ignore[call-overload]
    def run(payloads: pd.Series) -> pd.DataFrame:
        readers = {k: reader(w) for k, w in parsed.items()}
        rows = []
        for p in payloads:
            value, error = decode(bytes(p) if p is not None else None, readers, missing)
            rows.append((*((value or {}).get(n) for n in names), error))
        cols = list(zip(*rows)) if rows else [()] * (len(names) + 1)
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip([*names, "decode_error"], cols)})

    return run(payload)


def _number(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def write(schema: Any, v: Any) -> bytes:
    """The binary form of a value."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, list):
        n = next(i for i, p in enumerate(schema) if (p == "null") == (v is None))
        return _number(n) + (b"" if v is None else write(schema[n], v))
    if isinstance(kind, dict | list):
        return write(kind, v)
    if v is None:
        raise ValueError("a field that must have a value has none")
    if kind in ("long", "int"):
        return _number(int(v))
    if kind == "boolean":
        return b"\x01" if v else b"\x00"
    if kind == "string":
        b = str(v).encode()
        return _number(len(b)) + b
    if kind == "enum":
        return _number(schema["symbols"].index(v))
    if kind == "array":
        return (_number(len(v)) + b"".join(write(schema["items"], x) for x in v) if len(v) else b"") + b"\x00"
    return b"".join(write(f["type"], v[f["name"]]) for f in schema["fields"])


def encoded(row: Column, schema: Any, schema_id: int) -> Column:
    """Framed payloads of a struct column; null where a field has no value that its type allows."""
    head = b"\x00" + struct.pack(">i", schema_id)

    @F.pandas_udf(T.BinaryType())  # type: ignore[call-overload]
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            try:
                out.append(head + write(schema, r))
            except (ValueError, KeyError, StopIteration, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(row)

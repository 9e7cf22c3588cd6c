"""Rows as BSON documents, the compact binary form of results."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _element(name: str, value) -> bytes:
    """One element: a type byte, the name, the value. Types: 1 double, 2 text, 3 document, 4 array, 8 truth value, 10 null,
    16 and 18 whole numbers of 32 and 64 bits."""
    key = name.encode() + b"\0"
    if value is None:
        return b"\x0a" + key
    if isinstance(value, bool):
        return b"\x08" + key + bytes([value])
    if isinstance(value, int):
        small = -(2**31) <= value < 2**31
        return (b"\x10" + key + struct.pack("<i", value)) if small else (b"\x12" + key + struct.pack("<q", value))
    if isinstance(value, float):
        return b"\x01" + key + struct.pack("<d", value)
    if isinstance(value, dict):
        return b"\x03" + key + document(value)
    if isinstance(value, (list, tuple)):
        return b"\x04" + key + document({str(i): v for i, v in enumerate(value)})
    text = str(value).encode() + b"\0"
    return b"\x02" + key + struct.pack("<i", len(text)) + text


def document(values: dict) -> bytes:
    body = b"".join(_element(k, v) for k, v in values.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def parsed(raw: bytes) -> dict:
    """The document back."""
    out, at, end = {}, 4, struct.unpack_from("<i", raw)[0] - 1
    while at < end:
        kind, stop = raw[at], raw.index(b"\0", at + 1)
        name, at = raw[at + 1 : stop].decode(), stop + 1
        if kind == 10:
            out[name] = None
        elif kind == 8:
            out[name], at = bool(raw[at]), at + 1
        elif kind in (1, 16, 18):
            code, size = {1: ("<d", 8), 16: ("<i", 4), 18: ("<q", 8)}[kind]
            out[name], at = struct.unpack_from(code, raw, at)[0], at + size
        else:
            size = struct.unpack_from("<i", raw, at)[0]
            if kind == 2:
                out[name], at = raw[at + 4 : at + 3 + size].decode(), at + 4 + size
            else:
                inner = parsed(raw[at : at + size])
                out[name], at = (list(inner.values()) if kind == 4 else inner), at + size
    return out


def encoded(rows: DataFrame) -> DataFrame:
    """document binary: each row as one."""
    from skein.frontend.shipping import ship

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([document(x) for x in batch.to_pylist()], pa.binary())], ["document"])

    return rows.mapInArrow(run, "document binary")


def decoded(documents: DataFrame, schema: str) -> DataFrame:
    """The rows back, with a schema's columns."""
    from skein.frontend.shipping import ship

    spark = documents.sparkSession
    ship(spark)
    names = spark.createDataFrame([], schema).columns
    kinds = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in spark.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=kinds)

    return documents.select(F.col("document")).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else plain[kind]

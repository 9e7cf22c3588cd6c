"""Serialised R objects (.rda, .RData, .rds): XDR, ASCII and native binary, plain or compressed.

objects() lists what files hold without building frames of it; frame() gives one data frame's columns as rows.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Type codes of the format.
SYM, PAIRLIST, CLOSURE, ENV, PROMISE, LANG, SPECIAL, BUILTIN, CHAR, LOGICAL = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10
INTEGER, DOUBLE, COMPLEX, STRING, DOTS, LIST, EXPRESSION, BYTECODE, POINTER, WEAK, RAW, S4 = 13, 14, 15, 16, 17, 19, 20, 21, 22, 23, 24, 25
ALTREP, ATTR_PAIRLIST, ATTR_LANG, BASE_ENV, EMPTY_ENV = 238, 239, 240, 241, 242
PACKAGE, NAMESPACE, BASE_NAMESPACE, MISSING, UNBOUND, GLOBAL_ENV, NIL, REFERENCE = 248, 249, 250, 251, 252, 253, 254, 255
NAMES = {LOGICAL: "logical", INTEGER: "integer", DOUBLE: "double", COMPLEX: "complex", STRING: "character", LIST: "list", RAW: "raw", CLOSURE: "closure", ENV: "environment", PAIRLIST: "pairlist", LANG: "language", SYM: "symbol", S4: "S4", NIL: "NULL", EXPRESSION: "expression", BUILTIN: "builtin", SPECIAL: "special"}
NA_INT = -(2**31)


@dataclass
class Value:
    type: int
    data: Any = None
    attributes: dict[str, Value] = field(default_factory=dict)

    def strings(self, attribute: str) -> list[str]:
        x = self.attributes.get(attribute)
        return [str(v) for v in x.data] if x is not None and x.type in (STRING, INTEGER) else []

    @property
    def length(self) -> int:
        return len(self.data) if isinstance(self.data, list | bytes) else int(self.type != NIL)


class Unreadable(ValueError):
    pass


def unpacked(raw: bytes) -> bytes:
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:6] == b"\xfd7zXZ\x00" or raw[:3] == b"]\x00\x00":
        return lzma.decompress(raw)
    return raw


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.refs = raw, 0, []
        head = raw[:2]
        if head not in (b"X\n", b"A\n", b"B\n"):
            raise Unreadable("no serialised object")
        self.kind, self.at = chr(head[0]), 2
        self.order = ">" if self.kind == "X" else "<"
        version = self.int()
        self.int(), self.int()
        if version == 3:
            self.bytes(self.int())
        elif version != 2:
            raise Unreadable(f"version {version}")

    def word(self) -> str:
        while self.raw[self.at : self.at + 1].isspace():
            self.at += 1
        start = self.at
        while self.at < len(self.raw) and not self.raw[self.at : self.at + 1].isspace():
            self.at += 1
        if start == self.at:
            raise Unreadable("unexpected end")
        return self.raw[start : self.at].decode()

    def bytes(self, n: int) -> bytes:
        if self.kind == "A":
            while self.raw[self.at : self.at + 1] == b"\n":
                self.at += 1
            out = bytearray()
            while len(out) < n:
                c = self.raw[self.at : self.at + 1]
                if not c:
                    raise Unreadable("unexpected end")
                if c == b"\\":
                    nxt = self.raw[self.at + 1 : self.at + 2]
                    if nxt.isdigit():
                        digits = self.raw[self.at + 1 : self.at + 4]
                        out.append(int(digits, 8) & 0xFF)
                        self.at += 4
                        continue
                    out += {b"n": b"\n", b"t": b"\t", b"v": b"\v", b"b": b"\b", b"r": b"\r", b"f": b"\f", b"a": b"\a"}.get(nxt, nxt)
                    self.at += 2
                    continue
                out += c
                self.at += 1
            return bytes(out)
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise Unreadable("unexpected end")
        self.at += n
        return out

    def int(self) -> int:
        if self.kind == "A":
            w = self.word()
            return NA_INT if w == "NA" else int(w)
        return struct.unpack(self.order + "i", self.bytes(4))[0]

    def count(self) -> int:
        n = self.int()
        return n if n != -1 else (self.int() << 32) + (self.int() & 0xFFFFFFFF)

    def doubles(self, n: int) -> list[float]:
        if self.kind == "A":
            return [float({"NA": "nan", "Inf": "inf", "-Inf": "-inf"}.get(w := self.word(), w)) for _ in range(n)]
        return list(struct.unpack(f"{self.order}{n}d", self.bytes(8 * n)))

    def ints(self, n: int) -> list[int]:
        if self.kind == "A":
            return [self.int() for _ in range(n)]
        return list(struct.unpack(f"{self.order}{n}i", self.bytes(4 * n)))

    def item(self, flags: int | None = None) -> Value:
        """The next item; its flags may have been read already."""
        flags = self.int() if flags is None else flags
        kind, has_attributes, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
        if kind in (NIL, GLOBAL_ENV, UNBOUND, MISSING, BASE_NAMESPACE, BASE_ENV, EMPTY_ENV):
            return Value(kind)
        if kind == REFERENCE:
            n = flags >> 8 or self.int()
            return self.refs[n - 1]
        if kind == SYM:
            out = Value(SYM, self.item().data)
            self.refs.append(out)
            return out
        if kind in (PACKAGE, NAMESPACE):
            self.int()
            out = Value(kind, [self.item().data for _ in range(self.int())])
            self.refs.append(out)
            return out
        if kind == ENV:
            out = Value(ENV)
            self.refs.append(out)
            self.int()
            for _ in range(4):
                self.item()
            return out
        if kind in (PAIRLIST, LANG, CLOSURE, PROMISE, DOTS, ATTR_PAIRLIST, ATTR_LANG):
            return self.pairs(kind, has_attributes or kind in (ATTR_PAIRLIST, ATTR_LANG), has_tag)
        if kind == ALTREP:
            return self.compact()
        if kind == POINTER:
            out = Value(kind)
            self.refs.append(out)
            self.item(), self.item()
        elif kind == WEAK:
            out = Value(kind)
            self.refs.append(out)
        elif kind in (SPECIAL, BUILTIN):
            out = Value(kind, self.bytes(self.int()).decode())
        elif kind == CHAR:
            n = self.int()
            out = Value(CHAR, None if n == -1 else self.bytes(n).decode("latin-1" if flags >> 12 & 4 else "utf-8", "replace"))
        elif kind in (LOGICAL, INTEGER):
            out = Value(kind, [None if x == NA_INT else bool(x) if kind == LOGICAL else x for x in self.ints(self.count())])
        elif kind == DOUBLE:
            out = Value(kind, self.doubles(self.count()))
        elif kind == COMPLEX:
            n = self.count()
            flat = self.doubles(2 * n)
            out = Value(kind, [complex(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True)])
        elif kind == STRING:
            out = Value(kind, [self.item().data for _ in range(self.count())])
        elif kind in (LIST, EXPRESSION):
            out = Value(kind, [self.item() for _ in range(self.count())])
        elif kind == RAW:
            n = self.count()
            out = Value(kind, bytes(int(self.word(), 16) for _ in range(n)) if self.kind == "A" else self.bytes(n))
        elif kind == S4:
            out = Value(kind)
        else:
            raise Unreadable(f"type {kind}")
        if has_attributes:
            out.attributes = self.named(self.item())
        return out

    def pairs(self, kind: int, has_attributes: bool, has_tag: bool) -> Value:
        """A pair list, read in a loop: lists may be long."""
        out = Value({ATTR_PAIRLIST: PAIRLIST, ATTR_LANG: LANG}.get(kind, kind), [])
        while True:
            if has_attributes:
                attributes = self.named(self.item())
                if not out.data:
                    out.attributes = attributes
            tag = self.item() if has_tag else None
            out.data.append((tag.data if tag is not None else None, self.item()))
            flags = self.int()
            kind, has_attributes, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
            if kind not in (PAIRLIST, LANG, CLOSURE, PROMISE, DOTS, ATTR_PAIRLIST, ATTR_LANG):
                rest = self.item(flags)
                if rest.type != NIL:
                    out.data.append((None, rest))
                return out
            has_attributes = has_attributes or kind in (ATTR_PAIRLIST, ATTR_LANG)

    def compact(self) -> Value:
        """Alternative representations: compact sequences, deferred texts, wrappers."""
        info, state = self.item(), self.item()
        self.item()
        name = next((v.data for _, v in info.data), "") if isinstance(info.data, list) else ""
        if name in ("compact_intseq", "compact_realseq"):
            n, first, step = state.data
            return Value(INTEGER if "int" in name else DOUBLE, [(int if "int" in name else float)(first + i * step) for i in range(int(n))])
        if name == "deferred_string":
            held = state.data[0][1] if isinstance(state.data, list) and isinstance(state.data[0], tuple) else state
            return Value(STRING, [None if x is None else str(x) for x in held.data])
        if name.startswith("wrap_"):
            return state.data[0] if isinstance(state.data[0], Value) else state.data[0][1]
        raise Unreadable(f"representation {name}")

    @staticmethod
    def named(pairs: Value) -> dict[str, Value]:
        return {k: v for k, v in pairs.data if k} if isinstance(pairs.data, list) else {}


def read(raw: bytes) -> list[tuple[str | None, Value]]:
    """The objects of a file: (name, value); one without a name for .rds."""
    raw = unpacked(raw)
    if raw[:5] in (b"RDX2\n", b"RDX3\n", b"RDA2\n", b"RDA3\n", b"RDB2\n", b"RDB3\n"):
        out = Reader(raw[5:]).item()
        return list(out.data) if out.type == PAIRLIST else []
    return [(None, Reader(raw).item())]


def columns(v: Value) -> tuple[list[str], int]:
    """Column names and rows of a data frame."""
    rows = v.attributes.get("row.names")
    n = 0
    if rows is not None:
        n = abs(rows.data[1]) if rows.type == INTEGER and len(rows.data) == 2 and rows.data[0] is None else len(rows.data)
    return v.strings("names"), n


def cells(v: Value) -> list:
    """The values of a column; factors by their labels."""
    labels = v.strings("levels")
    return [None if x is None else labels[x - 1] for x in v.data] if labels else [x.data if isinstance(x, Value) else x for x in v.data]


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = []
            try:
                for name, v in read(raw or b""):
                    kind = v.strings("class")
                    names, n = columns(v) if "data.frame" in kind else (v.strings("names"), None)
                    out.append((path, name, NAMES.get(v.type, str(v.type)), kind, v.length, names, n, None))
            except (Unreadable, OSError, EOFError, struct.error, IndexError, RecursionError, lzma.LZMAError, zlib.error) as x:
                out = [(path, None, None, [], None, [], None, str(x) or type(x).__name__)]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], schema=_SCHEMA)


_SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("class", pa.list_(pa.string())), ("length", pa.int64()), ("names", pa.list_(pa.string())), ("rows", pa.int64()), ("error", pa.string())])
_DDL = "path string, name string, type string, class array<string>, length long, names array<string>, rows long, error string"


def objects(files: DataFrame) -> DataFrame:
    """path, name, type, class, length, names, rows (data frames), error: the objects in files (path, content binary)."""
    from skein.frontend.shipping import ship

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_objects, _DDL)


def frame(files: DataFrame, name: str | None = None) -> DataFrame:
    """path, row, values (map of column to text): the rows of the named data frame, or of the only one."""
    from skein.frontend.shipping import ship

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("values", pa.string())])
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(read(raw))
                except (ValueError, IndexError, KeyError, EOFError, OSError, struct.error, lzma.LZMAError, zlib.error):
                    continue  # objects() says what is wrong with it
                for own, v in found:
                    if "data.frame" in v.strings("class") and name in (None, own):
                        names = v.strings("names")
                        rows = zip(*[cells(c) for c in v.data], strict=True)
                        out = [{"path": path, "row": i + 1, "values": json.dumps({k: None if x is None else str(x) for k, x in zip(names, r, strict=True)})} for i, r in enumerate(rows)]
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    out = files.select("path", "content").mapInArrow(run, "path string, row long, values string")
    return out.withColumn("values", F.from_json("values", "map<string,string>"))

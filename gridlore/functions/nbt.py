"""Tagged binary documents: read, write, and columns of them as typed JSON.

A value is (kind, content), so that a byte and a long of the same number stay apart and what was read
can be written again. Stored payloads have no root name; root documents have an empty one.

Defined cases: no bytes, or a leading end tag, read as an empty compound; null gives null; bytes that are
cut short, of an unknown kind or nested deeper than DEPTH give an error; bytes after the value are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds by their tag byte; an empty list's items are of the kind "end".
KINDS = ["end", "byte", "short", "int", "long", "float", "double", "byte_array", "string", "list", "compound", "int_array", "long_array"]
#: Layouts of numbers and of the items of arrays, big-endian.
NUMBERS = {"byte": "b", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}
ARRAYS = {"byte_array": "b", "int_array": "i", "long_array": "q"}
#: Fixed value: the format's deepest nesting.
DEPTH = 512


class Tag(NamedTuple):
    kind: str
    value: Any


def _decode_string(raw: bytes) -> str:
    """Java's form of UTF-8: NUL takes two bytes, and characters above U+FFFF are pairs of surrogates."""
    text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "surrogatepass")


def _encode_string(text: str) -> bytes:
    units = text.encode("utf-16-be", "surrogatepass")
    single = "".join(map(chr, struct.unpack(f">{len(units) // 2}H", units)))
    raw = single.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")
    if len(raw) > 0xFFFF:
        raise ValueError(f"string of {len(raw)} bytes is too long")
    return struct.pack(">H", len(raw)) + raw


class _Reader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"needs {n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, layout: str) -> Any:
        return struct.unpack(f">{layout}", self.take(struct.calcsize(f">{layout}")))[0]

    def kind(self) -> str:
        code = self.number("B")
        if code >= len(KINDS):
            raise ValueError(f"unknown tag {code}")
        return KINDS[code]

    def string(self) -> str:
        return _decode_string(self.take(self.number("H")))

    def value(self, kind: str, depth: int = 0) -> Tag:
        if depth > DEPTH:
            raise ValueError(f"nested deeper than {DEPTH}")
        if kind in NUMBERS:
            return Tag(kind, self.number(NUMBERS[kind]))
        if kind in ARRAYS:
            n, item = self.number("i"), ARRAYS[kind]
            return Tag(kind, list(struct.unpack(f">{n}{item}", self.take(n * struct.calcsize(f">{item}")))) if n > 0 else [])
        if kind == "string":
            return Tag(kind, self.string())
        if kind == "list":
            of, n = self.kind(), self.number("i")
            if of == "end" and n > 0:
                raise ValueError("a list of end tags")
            return Tag(kind, [of, [self.value(of, depth + 1) for _ in range(n)]])
        if kind == "compound":
            fields = {}
            while (of := self.kind()) != "end":
                name = self.string()
                fields[name] = self.value(of, depth + 1)  # a later field replaces an earlier one
            return Tag(kind, fields)
        raise ValueError(f"no value of kind {kind}")


def _pieces(tag: Tag) -> Iterator[bytes]:
    kind, value = tag
    if kind in NUMBERS:
        yield struct.pack(f">{NUMBERS[kind]}", value)
    elif kind in ARRAYS:
        yield struct.pack(f">i{len(value)}{ARRAYS[kind]}", len(value), *value)
    elif kind == "string":
        yield _encode_string(value)
    elif kind == "list":
        of, items = value
        if any(item.kind != of for item in items):
            raise ValueError(f"a list of {of} with other kinds")
        yield struct.pack(">Bi", KINDS.index(of), len(items))
        for item in items:
            yield from _pieces(item)
    elif kind == "compound":
        for name, item in value.items():
            yield bytes([KINDS.index(item.kind)]) + _encode_string(name)
            yield from _pieces(item)
        yield b"\0"
    else:
        raise ValueError(f"no value of kind {kind}")


def read_payload(data: bytes) -> Tag:
    """A document without a root name."""
    if not data or data[0] == 0:
        return Tag("compound", {})
    reader = _Reader(data, 0)
    return reader.value(reader.kind())


def write_payload(tag: Tag) -> bytes:
    return bytes([KINDS.index(tag.kind)]) + b"".join(_pieces(tag))


def read_root(data: bytes) -> Tag:
    """A document with a root name, which is skipped."""
    reader = _Reader(data, 0)
    kind = reader.kind()
    reader.string()
    return reader.value(kind)


def write_root(tag: Tag) -> bytes:
    return bytes([KINDS.index(tag.kind)]) + b"\0\0" + b"".join(_pieces(tag))


def to_json(tag: Tag) -> str:
    """{kind: content}; a list is [kind of its items, contents]. Numbers that aren't finite are NaN and Infinity."""

    def plain(t: Tag) -> dict:
        if t.kind == "compound":
            return {t.kind: {k: plain(v) for k, v in t.value.items()}}
        if t.kind == "list":
            return {t.kind: [t.value[0], [plain(v)[v.kind] for v in t.value[1]]]}
        return {t.kind: t.value}

    return json.dumps(plain(tag), separators=(",", ":"))


def from_json(text: str) -> Tag:
    def typed(kind: str, value: Any) -> Tag:
        if kind == "compound":
            return Tag(kind, {k: typed(*next(iter(v.items()))) for k, v in value.items()})
        if kind == "list":
            return Tag(kind, [value[0], [typed(value[0], v) for v in value[1]]])
        return Tag(kind, value)

    return typed(*next(iter(json.loads(text).items())))


def payload_json(payload: Column) -> Column:
    """struct(json, error) of binary payloads."""

    @F.pandas_udf("json string, error string")
    def convert(payloads: pd.Series) -> pd.DataFrame:
        out = []
        for p in payloads:
            try:
                out.append((None if p is None else to_json(read_payload(bytes(p))), None))
            except (ValueError, RecursionError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["json", "error"], dtype="object")

    return convert(payload)


def json_root(document: Column) -> Column:
    """Binary root documents of typed JSON; JSON of another form fails the query."""

    @F.pandas_udf("binary")
    def convert(documents: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else write_root(from_json(d)) for d in documents], dtype="object")

    return convert(document)


def tile_entity(name: str | None, x: int, y: int, z: int, min_section_y: int, payload: bytes | None) -> Tag:
    """A tile entity's document: its base fields, replaced by the stored ones of the same name.

    y is counted from the lowest section, x and z stay local. A name without a namespace gets the usual one;
    no name is ":unknown". A stored document other than a compound adds nothing.
    """
    name = ":unknown" if name is None else name
    base = {
        "id": Tag("string", name if ":" in name else f"minecraft:{name}"),
        "keepPacked": Tag("byte", 0),
        "x": Tag("int", x),
        "y": Tag("int", 16 * min_section_y + y),
        "z": Tag("int", z),
    }
    try:
        stored = read_payload(payload or b"")
    except (ValueError, RecursionError) as e:
        raise ValueError(f"tile entity at ({x},{y},{z}): {e}") from e
    return Tag("compound", base | (stored.value if stored.kind == "compound" else {}))


def tile_entity_json(name: Column, x: Column, y: Column, z: Column, min_section_y: Column, payload: Column) -> Column:
    """struct(json, error) of tile entities; a null position or lowest section counts as 0."""

    @F.pandas_udf("json string, error string")
    def convert(names: pd.Series, xs: pd.Series, ys: pd.Series, zs: pd.Series, lows: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        out = []
        for n, px, py, pz, low, p in zip(names, xs, ys, zs, lows, payloads, strict=True):
            try:
                out.append((to_json(tile_entity(n, px, py, pz, low, None if p is None else bytes(p))), None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["json", "error"], dtype="object")

    whole = [F.coalesce(c.cast("int"), F.lit(0)) for c in (x, y, z, min_section_y)]
    return convert(name, *whole, payload)

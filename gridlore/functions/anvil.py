"""Chunk container files: a sector table, a time table and compressed chunk payloads, all big-endian.

Used per region group: (region, lx, lz, ts, write_order, payload) rows become one file of bytes. The
layout is small sums over at most 1024 chunks, so a group's size is bounded by the format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a sector, chunks on a side, first sector of payloads, compression type, largest payload.
SECTOR, SIDE, FIRST, ZLIB, TOO_LARGE = 4096, 32, 2, 2, 1_048_571


def sectors(payload_bytes: int) -> int:
    return -(-(payload_bytes + 5) // SECTOR)


def write_region(chunks: Iterable[tuple[int, int, int, bytes]]) -> bytes:
    """(lx, lz, unsigned time, compressed payload) in write order; a later chunk replaces an earlier one.

    The length field counts the payload without its type byte, as the files this is compatible with have it.
    """
    placed: dict[int, tuple[int, bytes]] = {}
    for lx, lz, ts, payload in chunks:
        if not (0 <= lx < SIDE and 0 <= lz < SIDE):
            raise ValueError(f"chunk ({lx}, {lz}) is outside the region")
        if len(payload) >= TOO_LARGE:
            raise ValueError(f"payload of {len(payload)} bytes is too large")
        placed[lz * SIDE + lx] = (ts, payload)
    where, times, body, at = bytearray(SECTOR), bytearray(SECTOR), [], FIRST
    for index in sorted(placed):
        ts, payload = placed[index]
        n = sectors(len(payload))
        struct.pack_into(">I", where, 4 * index, at << 8 | n)
        struct.pack_into(">I", times, 4 * index, ts)
        chunk = struct.pack(">IB", len(payload), ZLIB) + payload
        body.append(chunk + bytes(n * SECTOR - len(chunk)))
        at += n
    return bytes(where) + bytes(times) + b"".join(body)


def read_region(data: bytes) -> dict[tuple[int, int], tuple[int, bytes]]:
    """(lx, lz) -> (time, uncompressed payload)."""
    out = {}
    for index in range(SIDE * SIDE):
        place = struct.unpack_from(">I", data, 4 * index)[0]
        if place:
            at = (place >> 8) * SECTOR
            size = struct.unpack_from(">I", data, at)[0]
            out[index % SIDE, index // SIDE] = (struct.unpack_from(">I", data, SECTOR + 4 * index)[0], zlib.decompress(data[at + 5 : at + 5 + size]))
    return out


def region_files(chunks: DataFrame, region: str) -> DataFrame:
    """(region, file, error) from rows (region, lx, lz, ts, write_order, payload); a bad chunk fails its whole file."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("write_order")
        made, error = None, None
        try:
            made = write_region((int(r.lx), int(r.lz), int(r.ts), zlib.compress(bytes(r.payload))) for r in rows.itertuples())
        except ValueError as e:
            error = str(e)
        return pd.DataFrame({region: [rows[region].iloc[0]], "file": [made], "error": [error]})

    kind = chunks.schema[region].dataType.simpleString()
    return chunks.groupBy(region).applyInPandas(build, f"{region} {kind}, file binary, error string")

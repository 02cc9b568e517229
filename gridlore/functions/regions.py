"""Region files in two layouts: row-oriented with shared palettes, and columnar streams by level.

A region has up to 1024 segments; a segment has a history of snapshots (newest first) for each section of two
domains, a state log, and a keyed tile feed. File signatures are parameters of a Layout.

Defined cases: a palette of one entry is stored like any other; words that are too short read as index 0; an
index beyond its palette, a cut file, a wrong signature, version, dimension or length is a ValueError. The newest block
grid of a columnar file may be entropy-coded (Layout.modelled); files of both kinds are read.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np
import zstandard

from . import newest_grid

#: Segments of a region, sections by dimension code, cells by domain, sentinel of "unchanged".
SLOTS, SECTIONS, CELLS, UNCHANGED = 1024, {0: 24, 1: 16, 2: 16}, {"block": 4096, "biome": 64}, 0xFFFF
#: Newest version of the row layout, version of the columnar one, entries of an indirect palette, index of a direct one.
ROW_VERSION, COLUMNAR_VERSION, MOST_ENTRIES, DIRECT = 8, 1, 256, 0xFFFFFFFF
#: Longest history or state log, tile list, tile payload, words of a snapshot, palettes of a table.
MOST_DELTAS, MOST_TILES, MOST_PAYLOAD, MOST_WORDS, MOST_PALETTES = 65536, 98304, 65536, 1024, 262144
#: Names of the columnar streams in file order.
STREAMS = [
    "metadata", "model", "global_palette", "chunk_info", "timestamps", "singles", "local_palettes",
    "1b", "2b", "4b", "8b", "16b", "1m", "2m", "4m", "8m", "tile_entities",
]
_MARK = {"block": "b", "biome": "m"}


class Snapshot(NamedTuple):
    """One value for all cells, or words of indices into a palette; an empty palette: words of 16-bit atoms."""

    ts: int
    single: int | None = None
    palette: tuple[int, ...] = ()
    words: bytes = b""


@dataclass
class Segment:
    sections: dict[str, list[list[Snapshot]]]
    states: list[tuple[int, int]] = field(default_factory=list)  # (type, ts)
    tiles: list[tuple[int, dict[int, tuple[int, bytes] | None]]] = field(default_factory=list)  # (ts, position -> put or erase)


@dataclass
class Region:
    dim: int
    protocol: int
    version: int = ROW_VERSION
    segments: dict[int, Segment] = field(default_factory=dict)


def empty_segment(dim: int) -> Segment:
    return Segment({d: [[] for _ in range(SECTIONS[dim])] for d in CELLS})


def width(entries: int) -> int:
    return 16 if entries == 0 or entries > MOST_ENTRIES else next(b for b in (1, 2, 4, 8) if entries <= 1 << b)


def pack_words(values: np.ndarray, bits: int) -> bytes:
    """Low bits first, 64 / bits values a word, none across two words."""
    per = 64 // bits
    padded = np.zeros(-(-len(values) // per) * per, np.uint64)
    padded[: len(values)] = values
    shifted = padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(shifted, axis=1).astype("<u8").tobytes()


def unpack_words(words: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(words[: len(words) // 8 * 8], "<u8")
    each = raw[:, None] >> (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
    out = np.zeros(n, np.int64)
    got = each.ravel()[:n]
    out[: len(got)] = got
    return out


def pack(ts: int, atoms: np.ndarray) -> Snapshot:
    """Palette by count, ties by first sight."""
    found, first, codes, counts = np.unique(atoms, return_index=True, return_inverse=True, return_counts=True)
    if len(found) == 1:
        return Snapshot(ts, int(found[0]))
    if len(found) > MOST_ENTRIES:
        return Snapshot(ts, None, (), pack_words(np.asarray(atoms), 16))
    order = np.lexsort((first, -counts))
    return Snapshot(ts, None, tuple(found[order].tolist()), pack_words(np.argsort(order)[codes], width(len(found))))


def unpack(snapshot: Snapshot, cells: int) -> np.ndarray:
    if snapshot.single is not None:
        return np.full(cells, snapshot.single, np.int64)
    codes = unpack_words(snapshot.words, width(len(snapshot.palette)), cells)
    if not snapshot.palette:
        return codes
    if codes.max(initial=0) >= len(snapshot.palette):
        raise ValueError(f"index {codes.max()} is beyond a palette of {len(snapshot.palette)}")
    return np.asarray(snapshot.palette, np.int64)[codes]


def equal(a: Region, b: Region) -> bool:
    """Same segments, times, cells of every stored level, states and tiles; protocol, version and palettes may differ."""

    def same(p: Segment, q: Segment) -> bool:
        for domain, cells in CELLS.items():
            x, y = p.sections[domain], q.sections[domain]
            if [[s.ts for s in h] for h in x] != [[s.ts for s in h] for h in y]:
                return False
            if not all(np.array_equal(unpack(s, cells), unpack(t, cells)) for g, h in zip(x, y, strict=True) for s, t in zip(g, h, strict=True)):
                return False
        return p.states == q.states and p.tiles == q.tiles

    return a.segments.keys() == b.segments.keys() and all(same(s, b.segments[k]) for k, s in a.segments.items())


def voxels(region: Region) -> int:
    return len(region.segments) * SECTIONS[region.dim] * CELLS["block"]


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"needs {n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def one(self, layout: str, most: int | None = None) -> int:
        value = struct.unpack(f"<{layout}", self.take(struct.calcsize(f"<{layout}")))[0]
        if most is not None and value > most:
            raise ValueError(f"length {value} is above {most}")
        return value

    def many(self, layout: str, n: int) -> tuple[int, ...]:
        return struct.unpack(f"<{n}{layout}", self.take(n * struct.calcsize(f"<{layout}")))


def _put(layout: str, *values: int) -> bytes:
    return struct.pack(f"<{len(values)}{layout}", *values)


class _Sizes(NamedTuple):
    """Bytes of a file, and of it uncompressed."""

    stored: int
    raw: int


@dataclass(frozen=True)
class Layout:
    """A file layout: signature and whether columnar. newest: read only so many snapshots of a history (rows; 0: all).

    modelled: a columnar file's newest block grid is written by the context-mixing model.
    """

    signature: bytes
    columnar: bool = False
    level: int = 8
    newest: int = 0
    modelled: bool = False

    def encode(self, region: Region) -> bytes:
        for slot, s in region.segments.items():
            if any(len(h) != SECTIONS[region.dim] for h in s.sections.values()):
                raise ValueError(f"segment {slot} doesn't have the dimension's {SECTIONS[region.dim]} sections")
        body = b"".join(_to_streams(region, self.modelled).values()) if self.columnar else _to_rows(region)
        version = COLUMNAR_VERSION if self.columnar else region.version
        return self.signature + _put("B", version, region.dim) + _put("H", region.protocol) + zstandard.ZstdCompressor(level=self.level).compress(body)

    def decode(self, data: bytes) -> Region:
        head = _Cursor(data)
        if head.take(len(self.signature)) != self.signature:
            raise ValueError("another signature")
        version, dim, protocol = head.one("B"), head.one("B"), head.one("H")
        if not 1 <= version <= (COLUMNAR_VERSION if self.columnar else ROW_VERSION):
            raise ValueError(f"unknown version {version}")
        if dim not in SECTIONS:
            raise ValueError(f"unknown dimension {dim}")
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(data[head.at :])
        except zstandard.ZstdError as e:
            raise ValueError(f"body: {e}") from e
        region = Region(dim, protocol, ROW_VERSION if self.columnar else version)
        (_from_streams if self.columnar else _from_rows)(_Cursor(body), region, self.newest)
        return region

    def sizes(self, data: bytes) -> _Sizes:
        """A frame that doesn't say its size counts as stored."""
        head = len(self.signature) + 4
        try:
            n = zstandard.frame_content_size(data[head:])
        except zstandard.ZstdError:
            n = -1
        return _Sizes(len(data), n + head if n >= 0 else len(data))


# Row layout: two palette tables, then each segment's domains, states and tiles in turn.


def _to_rows(region: Region) -> bytes:
    tables: dict[str, dict[tuple[int, ...], int]] = {d: {} for d in CELLS}
    out: list[bytes] = []
    for slot in range(SLOTS):
        segment = region.segments.get(slot)
        out.append(_put("B", segment is not None))
        if segment is None:
            continue
        for domain in CELLS:
            for history in segment.sections[domain]:
                out.append(_put("Q", len(history)))
                for s in history:
                    if s.single is not None:
                        out.append(struct.pack("<qBH", s.ts, 0, s.single))
                        continue
                    known = tables[domain]
                    index = known.setdefault(s.palette, len(known)) if s.palette else DIRECT
                    out += [struct.pack("<qBQ", s.ts, 1, len(s.words) // 8), s.words, _put("I", index)]
        out.append(_put("Q", len(segment.states)))
        out += [struct.pack("<Bq", *s) for s in segment.states]
        out.append(_put("Q", len(segment.tiles)))
        for ts, feed in segment.tiles:
            out.append(struct.pack("<qQ", ts, len(feed)))
            for position, tile in sorted(feed.items()):
                out.append(_put("I", position) + (b"\0" if tile is None else struct.pack("<BIQ", 1, tile[0], len(tile[1])) + tile[1]))
    heads = [_put("I", len(t)) + b"".join(_put("H", len(p), *p) for p in t) for t in tables.values()]
    return b"".join(heads + out)


def _from_rows(c: _Cursor, region: Region, newest: int) -> None:
    tables: dict[str, list[tuple[int, ...]]] = {}
    for domain in CELLS:
        tables[domain] = []
        for _ in range(c.one("I", MOST_PALETTES)):
            n = c.one("H")
            atoms = c.many("H", n)
            tables[domain].append(atoms if n <= MOST_ENTRIES else ())
    for slot in range(SLOTS):
        if c.one("B") == 0:
            continue
        segment = region.segments[slot] = empty_segment(region.dim)
        for domain in CELLS:
            for history in segment.sections[domain]:
                for level in range(c.one("Q", MOST_DELTAS)):
                    s = _row_snapshot(c, tables[domain])
                    if newest == 0 or level < newest:
                        history.append(s)
        for _ in range(c.one("Q", MOST_DELTAS)):
            segment.states.append((c.one("B", 2), c.one("q")))
        for _ in range(c.one("Q", MOST_DELTAS)):
            ts, feed = c.one("q"), {}
            for _ in range(c.one("Q", MOST_TILES)):
                position = c.one("I")
                feed[position] = (c.one("I"), c.take(c.one("Q", MOST_PAYLOAD))) if c.one("B") else None
            segment.tiles.append((ts, feed))


def _row_snapshot(c: _Cursor, table: list[tuple[int, ...]]) -> Snapshot:
    ts = c.one("q")
    if c.one("B") == 0:
        return Snapshot(ts, c.one("H"))
    words, index = c.take(8 * c.one("Q", MOST_WORDS)), c.one("I")
    if index != DIRECT and index >= len(table):
        raise ValueError(f"palette {index} of {len(table)}")
    return Snapshot(ts, None, () if index == DIRECT else table[index], words)


# Columnar layout: one stream a field, snapshots in order of level, slot and section.


def _level_major(histories: dict[tuple[int, int], list[Any]], first: int = 0) -> Iterator[Any]:
    for level in range(first, max(map(len, histories.values()), default=0)):
        yield from (h[level] for h in histories.values() if len(h) > level)


def _histories(region: Region, domain: str) -> dict[tuple[int, int], list[Snapshot]]:
    return {(slot, i): h for slot, s in sorted(region.segments.items()) for i, h in enumerate(s.sections[domain])}


def _kind(s: Snapshot) -> int:
    return 1 if s.single is not None else 2


def _bitmap(values: np.ndarray, bits: int) -> bytes:
    """First value in the highest bits."""
    grouped = values.astype(np.uint8).reshape(-1, 8 // bits)
    return np.bitwise_or.reduce(grouped << np.arange(8 - bits, -1, -bits, dtype=np.uint8), axis=1).astype(np.uint8).tobytes()


def _from_bitmap(raw: bytes, bits: int) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8)[:, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & ((1 << bits) - 1)).ravel()


def _ranked(s: Snapshot, cells: int) -> tuple[tuple[int, ...], np.ndarray]:
    """Used entries by count, ties by place in the palette (by atom where direct), and the cells' ranks in it."""
    if s.palette:
        unpack(s, cells)  # refuses an index beyond the palette
        source, codes = np.asarray(s.palette), unpack_words(s.words, width(len(s.palette)), cells)
        used, codes, counts = np.unique(codes, return_inverse=True, return_counts=True)
        atoms = source[used]
    else:
        atoms, codes, counts = np.unique(unpack(s, cells), return_inverse=True, return_counts=True)
    if len(atoms) > MOST_ENTRIES:
        return (), atoms[codes]
    order = np.argsort(-counts, kind="stable")
    return tuple(atoms[order].tolist()), np.argsort(order)[codes]


def newest_atoms(s: Snapshot) -> np.ndarray | int:
    """A block snapshot's cells as the model sees them: what its words don't reach is atom 0."""
    if s.single is not None:
        return s.single
    bits = width(len(s.palette))
    reached = min(len(s.words) * 8 // bits, CELLS["block"])
    atoms = unpack(s, CELLS["block"]) if reached == CELLS["block"] or not s.palette else np.append(unpack(s, reached), np.zeros(CELLS["block"] - reached, np.int64))
    return int(atoms[0]) if (atoms == atoms[0]).all() else atoms


def _to_streams(region: Region, modelled: bool = False) -> dict[str, bytes]:
    out: dict[str, bytearray] = {name: bytearray() for name in STREAMS}
    present = np.zeros(SLOTS, np.uint8)
    present[list(region.segments)] = 1
    meta, by_domain = out["metadata"], {d: _histories(region, d) for d in CELLS}
    meta += _bitmap(present, 1)
    for histories in by_domain.values():
        kinds = np.zeros(SLOTS * SECTIONS[region.dim], np.uint8)
        for (slot, section), h in histories.items():
            kinds[slot * SECTIONS[region.dim] + section] = _kind(h[0]) if h else 0
        meta += _bitmap(kinds, 2)
    for histories in by_domain.values():
        lengths = [len(h) for h in histories.values() if h]
        if max(lengths, default=0) > 0xFFFF:
            raise ValueError(f"a history of {max(lengths)} snapshots is too long")
        meta += _put("H", *lengths)
    for histories in by_domain.values():
        meta += bytes(_kind(s) for s in _level_major(histories, 1))
    grid = b""
    if modelled:
        grid = newest_grid.encode({key: newest_atoms(h[0]) for key, h in by_domain["block"].items() if h}, SECTIONS[region.dim])
    out["model"] += _put("I", len(grid)) + grid
    for domain, histories in by_domain.items():
        told = sum(map(bool, histories.values())) if grid and domain == "block" else 0
        _domain_streams(out, domain, list(_level_major(histories)), told)
    for _, segment in sorted(region.segments.items()):
        if len(segment.states) > 0xFFFF:
            raise ValueError(f"a log of {len(segment.states)} states is too long")
        out["chunk_info"] += _put("H", len(segment.states)) + bytes(k for k, _ in segment.states) + _put("q", *(t for _, t in segment.states))
        tiles = out["tile_entities"]
        tiles += _put("I", len(segment.tiles))
        for ts, feed in segment.tiles:
            rows = sorted(feed.items())
            puts = [t for _, t in rows if t is not None]
            if len(rows) > MOST_TILES or any(len(nbt) > MOST_PAYLOAD for _, nbt in puts):
                raise ValueError("a tile list or payload is too long")
            tiles += _put("q", ts) + _put("I", len(rows), *(p for p, _ in rows)) + bytes(t is not None for _, t in rows)
            tiles += _put("I", *(k for k, _ in puts), *(len(nbt) for _, nbt in puts)) + b"".join(nbt for _, nbt in puts)
    return {name: bytes(part) for name, part in out.items()}


def _domain_streams(out: dict[str, bytearray], domain: str, ordered: list[Snapshot], told: int = 0) -> None:
    """told: so many first snapshots, those of level 0, have their cells in the model."""
    cells, members = CELLS[domain], set()
    for s in ordered[told:]:
        if s.single is None:
            members.update(s.palette or np.unique(unpack(s, cells)).tolist())
    ids = {atom: i for i, atom in enumerate(sorted(members))}
    out["global_palette"] += _put("I", len(ids)) + _put("H", *ids)
    out["timestamps"] += _put("q", *(s.ts for s in ordered))
    for s in ordered[told:]:
        if s.single is not None:
            out["singles"] += _put("H", s.single)
            continue
        palette, codes = _ranked(s, cells)
        out["local_palettes"] += _put("H", len(palette), *(ids[a] for a in palette))
        out[f"{width(len(palette))}{_MARK[domain]}"] += pack_words(codes, width(len(palette)))


def _from_streams(c: _Cursor, region: Region, newest: int) -> None:
    sections = SECTIONS[region.dim]
    slots = np.flatnonzero(_from_bitmap(c.take(SLOTS // 8), 1)).tolist()
    region.segments = {slot: empty_segment(region.dim) for slot in slots}
    kinds: dict[str, dict[tuple[int, int], list[int]]] = {}
    for domain in CELLS:
        flat = _from_bitmap(c.take(SLOTS * sections // 4), 2).reshape(SLOTS, sections)
        if flat.max() > 2 or set(np.flatnonzero(flat.any(axis=1)).tolist()) - set(slots):
            raise ValueError(f"invalid {domain} descriptors")
        kinds[domain] = {(slot, i): [int(flat[slot, i])] for slot in slots for i in range(sections) if flat[slot, i]}
    lengths = {d: dict(zip(kinds[d], c.many("H", len(kinds[d])), strict=True)) for d in CELLS}
    for domain in CELLS:
        if 0 in lengths[domain].values():
            raise ValueError(f"an empty {domain} history has a descriptor")
        for level in range(1, max(lengths[domain].values(), default=0)):
            for key, n in lengths[domain].items():
                if n > level:
                    kinds[domain][key].append(c.one("B"))
        if any(k not in (1, 2) for of in kinds[domain].values() for k in of):
            raise ValueError(f"invalid {domain} tags")
    payload = c.take(c.one("I"))
    told = {d: len(kinds[d]) if payload and d == "block" else 0 for d in CELLS}
    shared = {d: c.many("H", c.one("I", 1 << 16)) for d in CELLS}
    for slot in slots:
        n = c.one("H")
        types, times = c.take(n), c.many("q", n)
        if any(k > 2 for k in types):
            raise ValueError("unknown state")
        region.segments[slot].states = list(zip(types, times, strict=True))
    ordered = {d: list(_level_major(kinds[d])) for d in CELLS}
    times = {d: c.many("q", len(ordered[d])) for d in CELLS}
    singles = {d: iter(c.many("H", ordered[d][told[d] :].count(1))) for d in CELLS}
    local = {d: [c.many("H", c.one("H", MOST_ENTRIES)) for _ in range(ordered[d][told[d] :].count(2))] for d in CELLS}
    sizes: dict[str, int] = defaultdict(int)
    length = lambda d, palette: -(-CELLS[d] * width(len(palette)) // 64) * 8
    for domain in CELLS:
        for palette in local[domain]:
            sizes[f"{width(len(palette))}{_MARK[domain]}"] += length(domain, palette)
    if "16m" in sizes:
        raise ValueError("a direct palette has no place in the biome streams")
    packed = {name: _Cursor(c.take(sizes[name])) for name in STREAMS[7:16]}
    for domain in CELLS:
        found: list[Snapshot] = []
        if told[domain]:
            grid, atoms, same = newest_grid.decode(payload, sections)
            for ts, key in zip(times[domain], kinds[domain], strict=False):
                found.append(Snapshot(ts, int(atoms[same[key]])) if key in same else pack(ts, newest_grid.tile(grid, atoms, *key)))
        entries = iter(local[domain])
        for ts, kind in zip(times[domain][told[domain] :], ordered[domain][told[domain] :], strict=True):
            if kind == 1:
                found.append(Snapshot(ts, next(singles[domain])))
                continue
            palette = next(entries)
            if any(i >= len(shared[domain]) for i in palette):
                raise ValueError("a local palette is beyond the shared one")
            words = packed[f"{width(len(palette))}{_MARK[domain]}"].take(length(domain, palette))
            found.append(Snapshot(ts, None, tuple(shared[domain][i] for i in palette), words))
        where = _level_major({key: [key] * n for key, n in lengths[domain].items()})
        for (slot, section), s in zip(where, found, strict=True):
            history = region.segments[slot].sections[domain][section]
            if newest == 0 or len(history) < newest:
                history.append(s)
    for slot in slots:
        for _ in range(c.one("I", MOST_TILES)):
            ts, n = c.one("q"), c.one("I", MOST_TILES)
            positions, ops = c.many("I", n), c.take(n)
            if any(a >= b for a, b in zip(positions, positions[1:], strict=False)) or any(op > 1 for op in ops):
                raise ValueError("tile positions must ascend and their operations be 0 or 1")
            puts = [p for p, op in zip(positions, ops, strict=True) if op]
            types, bytes_each = c.many("I", len(puts)), c.many("I", len(puts))
            if max(bytes_each, default=0) > MOST_PAYLOAD:
                raise ValueError("a tile payload is too long")
            stored = {p: (k, c.take(m)) for p, k, m in zip(puts, types, bytes_each, strict=True)}
            region.segments[slot].tiles.append((ts, {p: stored.get(p) for p in positions}))


def stream_sizes(region: Region, level: int = 8, modelled: bool = False) -> list[tuple[str, int, int]]:
    """(stream, bytes, bytes compressed alone) of the columnar layout; 'buckets' is all packed streams as one."""
    streams = _to_streams(region, modelled)
    streams["buckets"] = b"".join(streams[name] for name in STREAMS[7:16])
    return [(name, len(part), len(zstandard.ZstdCompressor(level=level).compress(part))) for name, part in streams.items()]


def bucket_counts(region: Region, modelled: bool = False) -> dict[str, int]:
    """Packed snapshots of each bucket stream."""
    counts = dict.fromkeys(STREAMS[7:16], 0)
    for domain in CELLS:
        for history in _histories(region, domain).values():
            for s in history[1:] if modelled and domain == "block" else history:
                if s.single is None:
                    counts[f"{width(len(_ranked(s, CELLS[domain])[0]))}{_MARK[domain]}"] += 1
    return counts

"""Region files as chunk container files of one moment: as-of state, names, re-packing, tagged documents.

A file is a unit of work of bounded size; files spread over tasks. Registries are held by every task, so their
ids are bounded: 65 536 blocks and biomes by the width of an id, and most_tile_types (an argument) tile types.

Defined cases: a segment with an empty section has no state and is left out, so is an absent one; an unknown
name, protocol, dimension or tile document fails its file, with an error and no content; an output that exists
already is skipped and its region is not decoded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anvil, nbt
from ..functions import regions as rg
from ..functions.nbt import Tag
from ..functions.scalars import DATA_VERSIONS, parse_file_name
from .file_sink import place
from .region_files import each_file
from .registry_json import registry

#: Fixed values by dimension code: lowest section, folder of outputs.
LOWEST, FOLDERS = {0: -4, 1: 0, 2: 0}, {0: "region", 1: "DIM-1/region", 2: "DIM1/region"}
#: Bytes of a light array, least bits of an index by domain, shown name of an unknown id.
LIGHT, LEAST_BITS, UNKNOWN = 2048, {"block": 4, "biome": 0}, ":unknown"


@dataclass(frozen=True)
class Names:
    block: dict[int, tuple[str, dict[str, str]]]
    biome: dict[int, str]
    tile: dict[int, str]


def load_names(spark: SparkSession, root: str, protocol: int, most_tile_types: int = 65_536) -> Names:
    """The three registries of a protocol; the last of several entries of an id counts."""
    tiles = registry(spark, root, protocol, "tile")
    if tiles.count() > most_tile_types:
        raise ValueError(f"more than {most_tile_types} tile types")
    rows = {kind: registry(spark, root, protocol, kind).collect() for kind in ("block", "biome")}
    block = {r.id: (r.name, dict(r.properties or {})) for r in rows["block"]}
    return Names(block, {r.id: r.name for r in rows["biome"]}, {r.id: r.name for r in tiles.collect()})


def grid_at(history: list[rg.Snapshot], ts: int, cells: int) -> np.ndarray | None:
    """Cells at the newest snapshot not after ts, else at the oldest; older levels replace what they hold."""
    if not history:
        return None
    upto = next((level for level, s in enumerate(history) if s.ts <= ts), len(history) - 1)
    grid = rg.unpack(history[0], cells)
    for s in history[1 : upto + 1]:
        older = rg.unpack(s, cells)
        grid = np.where(older == rg.UNCHANGED, grid, older)
    return grid


def tiles_at(lists: list[tuple[int, dict[int, tuple[int, bytes] | None]]], ts: int) -> dict[int, tuple[int, bytes]]:
    """Keyed entries at the newest list not after ts, else at the oldest."""
    upto = next((level for level, (t, _) in enumerate(lists) if t <= ts), len(lists) - 1)
    kept: dict[int, tuple[int, bytes]] = {}
    for _, feed in lists[: upto + 1]:
        kept |= {p: t for p, t in feed.items() if t is not None}
        for p in (p for p, t in feed.items() if t is None):
            kept.pop(p, None)
    return kept


def nearest_time(segment: rg.Segment, ts: int) -> int:
    """Of tile, block and biome times, in that order, the first that is nearest to ts."""
    times = [t for t, _ in segment.tiles] + [s.ts for d in rg.CELLS for h in segment.sections[d] for s in h]
    return min(times, key=lambda t: abs(t - ts), default=ts)


def pack_first_seen(atoms: np.ndarray, least_bits: int) -> tuple[list[int], list[int]]:
    """Palette by first sight, and longs of as few bits an index as it needs; none for a single entry."""
    found, first, codes = np.unique(atoms, return_index=True, return_inverse=True)
    order = np.argsort(first)
    if len(found) == 1:
        return found.tolist(), []
    words = rg.pack_words(np.argsort(order)[codes], max((len(found) - 1).bit_length(), least_bits))
    return found[order].tolist(), np.frombuffer(words, "<i8").tolist()


def _named(name: str | None) -> Tag:
    name = name or UNKNOWN
    return Tag("string", name if ":" in name else f"minecraft:{name}")


def _block(entry: tuple[str, dict[str, str]] | None) -> Tag:
    name, properties = entry or (None, {})
    fields = {"Name": _named(name)}
    if properties:
        fields["Properties"] = Tag("compound", {k: Tag("string", v) for k, v in properties.items()})
    return Tag("compound", fields)


def _packed(kind: str, palette: list[Tag], longs: list[int]) -> Tag:
    return Tag("compound", {"palette": Tag("list", [kind, palette])} | ({"data": Tag("long_array", longs)} if longs else {}))


def _section(y: int, grids: dict[str, np.ndarray], names: Names) -> Tag:
    palettes = {d: pack_first_seen(grids[d], LEAST_BITS[d]) for d in rg.CELLS}
    light = Tag("byte_array", [-1] * LIGHT)
    return Tag("compound", {
        "Y": Tag("byte", y),
        "block_states": _packed("compound", [_block(names.block.get(a)) for a in palettes["block"][0]], palettes["block"][1]),
        "biomes": _packed("string", [_named(names.biome.get(a)) for a in palettes["biome"][0]], palettes["biome"][1]),
        "BlockLight": light, "SkyLight": light,
    })


def chunk_document(segment: rg.Segment, dim: int, x: int, z: int, ts: int, data_version: int, names: Names) -> Tag | None:
    """The document of a segment at ts with absolute coordinates x, z; None if a section has no history."""
    grids = {d: [grid_at(h, ts, n) for h in segment.sections[d]] for d, n in rg.CELLS.items()}
    if any(g is None for of in grids.values() for g in of):
        return None
    low = LOWEST[dim]
    tiles = [
        nbt.tile_entity(names.tile.get(kind), p & 255, p >> 16, p >> 8 & 255, low, payload)
        for p, (kind, payload) in sorted(tiles_at(segment.tiles, ts).items())
    ]
    listed = lambda kind, items: Tag("list", [kind if items else "end", items])
    sections = [_section(i + low, {d: grids[d][i] for d in rg.CELLS}, names) for i in range(len(grids["block"]))]
    return Tag("compound", {
        "DataVersion": Tag("int", data_version), "Heightmaps": Tag("compound", {}), "InhabitedTime": Tag("long", 0), "LastUpdate": Tag("long", 0),
        "xPos": Tag("int", x), "zPos": Tag("int", z), "yPos": Tag("int", low), "Status": Tag("string", "minecraft:full"),
        "block_ticks": listed("end", []), "fluid_ticks": listed("end", []), "isLightOn": Tag("byte", 1),
        "block_entities": listed("compound", tiles), "sections": listed("compound", sections),
    })


def export_region(region: rg.Region, dim: int, rx: int, rz: int, ts: int, registries: dict[int, Names]) -> bytes:
    if region.protocol not in registries or region.protocol not in DATA_VERSIONS:
        raise ValueError(f"unsupported protocol {region.protocol}")
    if region.dim != dim:
        raise ValueError(f"dimension {region.dim} instead of {dim}")
    chunks = []
    for slot, segment in sorted(region.segments.items()):
        lx, lz = divmod(slot, anvil.SIDE)
        made = chunk_document(segment, dim, rx * anvil.SIDE + lx, rz * anvil.SIDE + lz, ts, DATA_VERSIONS[region.protocol], registries[region.protocol])
        if made is not None:
            at = min(max(nearest_time(segment, ts), 0), 0xFFFFFFFF)
            chunks.append((lx, lz, at, zlib.compress(nbt.write_root(made))))
    return anvil.write_region(chunks)


def export_files(files: DataFrame, layout: rg.Layout, dim: int, suffix: str, out_suffix: str, ts: int, registries: dict[int, Names], done: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """(path, out_path, outcome, content, in_bytes, out_bytes, error) of (path, content) rows.

    root (a URI): each result is moved to its place below root, content is null and the outcome is written; without
    root it is made, with the content. Other outcomes: failed, skipped.

    done holds the out_paths that exist; their files are not decoded. That is the only join: Spark broadcasts done
    by its size, and otherwise shuffles the files once. Without done there is no shuffle.
    """
    rx, rz = parse_file_name(F.element_at(F.split("path", "/"), -1), suffix)
    out_path = F.concat(F.lit(f"{FOLDERS[dim]}/r."), rx.cast("string"), F.lit("."), rz.cast("string"), F.lit(f".{out_suffix}"))
    todo = files.select("path", "content", rx.alias("rx"), rz.alias("rz"), out_path.alias("out_path"))
    if done is not None:
        todo = todo.join(done.select("out_path", F.lit(True).alias("held")).distinct(), "out_path", "left")
    todo = todo.withColumn("held", F.coalesce("held", F.lit(False)) if done is not None else F.lit(False))

    def one(row: dict[str, Any]) -> dict[str, Any]:
        content = row["content"]
        size = None if content is None else len(content)
        if row["held"]:
            return {"outcome": "skipped", "in_bytes": size}
        try:
            if row["out_path"] is None:
                raise ValueError("not a region file's name")
            if content is None:
                raise ValueError("no content")
            made = export_region(layout.decode(content), dim, row["rx"], row["rz"], ts, registries)
            if root is None:
                return {"outcome": "made", "made": made, "in_bytes": size, "out_bytes": len(made)}
            fs, base = pafs.FileSystem.from_uri(root)
            place(fs, f"{base}/{row['out_path']}", made)
            return {"outcome": "written", "in_bytes": size, "out_bytes": len(made)}
        except (ValueError, OSError) as e:
            return {"outcome": "failed", "in_bytes": size, "error": str(e)}

    out = each_file(todo, one, "outcome string, made binary, in_bytes long, out_bytes long, error string")
    return out.select("path", "out_path", "outcome", F.col("made").alias("content"), "in_bytes", "out_bytes", "error")


def export_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files by outcome, bytes in and out of those written or made, and the size ratio."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("written", "made", "skipped", "failed")]
    sums = [F.sum(F.when(F.col("outcome").isin("written", "made"), F.col(c))).alias(c) for c in ("in_bytes", "out_bytes")]
    done = outcomes.agg(F.count("*").alias("files"), *counts, *sums)
    return done.select("*", F.try_divide(F.col("out_bytes") - F.col("in_bytes"), F.col("in_bytes")).alias("ratio"))

"""Region files as tables of records, and back; conversion between layouts with a check of each result.

A file is a unit of work: its size is bounded by the format (1024 segments), its rows are made or read in one
task, and files spread over tasks. Files come from Spark's binaryFile reader, so any store works; a batch of
them is bounded by spark.sql.execution.arrow.maxRecordsPerBatch, which a session with large files should lower.

A file that can't be read or written gives one record with an error and no others; null content counts as one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regions as rg

#: One row a record: region (header), segment, snapshot, state, tiles (a list's head), tile (null type: erase).
FIELDS = (
    "dim int, protocol int, version int, record string, slot int, domain string, section int, level int, ts long, single int, "
    "palette array<int>, words binary, state int, pos long, tile_type long, nbt binary, error string"
)
NAMES = [f.strip().split()[0] for f in FIELDS.split(",")]
OUTCOME = (
    "content binary, in_bytes long, out_bytes long, in_raw long, out_raw long, voxels long, read_ns long, write_ns long, reread_ns long, "
    "same boolean, error string"
)


def to_records(region: rg.Region) -> Iterator[dict[str, Any]]:
    head = {"dim": region.dim, "protocol": region.protocol, "version": region.version}
    yield {**head, "record": "region"}
    for slot, segment in sorted(region.segments.items()):
        at = {**head, "slot": slot}
        yield {**at, "record": "segment"}
        for domain, histories in segment.sections.items():
            for section, history in enumerate(histories):
                for level, s in enumerate(history):
                    palette = None if s.single is not None else list(s.palette)
                    words = None if s.single is not None else s.words
                    yield {**at, "record": "snapshot", "domain": domain, "section": section, "level": level, "ts": s.ts, "single": s.single, "palette": palette, "words": words}
        for level, (state, ts) in enumerate(segment.states):
            yield {**at, "record": "state", "level": level, "ts": ts, "state": state}
        for level, (ts, feed) in enumerate(segment.tiles):
            yield {**at, "record": "tiles", "level": level, "ts": ts}
            for pos, tile in sorted(feed.items()):
                put = {} if tile is None else {"tile_type": tile[0], "nbt": tile[1]}
                yield {**at, "record": "tile", "level": level, "ts": ts, "pos": pos, **put}


def from_records(rows: list[dict[str, Any]]) -> rg.Region:
    """Records in any order; levels give the order of a history. A record of a slot makes its segment present."""
    first = rows[0]
    region = rg.Region(int(first["dim"]), int(first["protocol"]), int(first["version"]))
    if region.dim not in rg.SECTIONS:
        raise ValueError(f"unknown dimension {region.dim}")
    for r in sorted((r for r in rows if r["record"] != "region"), key=lambda r: (r["slot"], r["level"] or 0, r["record"] == "tile")):
        if not 0 <= r["slot"] < rg.SLOTS:
            raise ValueError(f"slot {r['slot']} is outside the region")
        segment = region.segments.setdefault(int(r["slot"]), rg.empty_segment(region.dim))
        if r["record"] == "snapshot":
            if not 0 <= r["section"] < rg.SECTIONS[region.dim]:
                raise ValueError(f"section {r['section']} is outside the dimension")
            made = rg.Snapshot(r["ts"], r["single"]) if r["single"] is not None else rg.Snapshot(r["ts"], None, tuple(map(int, r["palette"])), bytes(r["words"]))
            segment.sections[r["domain"]][r["section"]].append(made)
        elif r["record"] == "state":
            segment.states.append((r["state"], r["ts"]))
        elif r["record"] == "tiles":
            segment.tiles.append((r["ts"], {}))
        elif r["record"] == "tile":
            segment.tiles[r["level"]][1][r["pos"]] = None if r["tile_type"] is None else (r["tile_type"], bytes(r["nbt"]))
    return region


def _frame(rows: list[dict[str, Any]], **key: Any) -> pd.DataFrame:
    whole = ("dim", "protocol", "version", "slot", "section", "level", "ts", "single", "state", "pos", "tile_type")
    return pd.DataFrame({**{k: [v] * len(rows) for k, v in key.items()}, **{n: pd.array([r.get(n) for r in rows], "Int64") if n in whole else pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES}})


def read_region_files(files: DataFrame, layout: rg.Layout, rows_a_frame: int = 4096) -> DataFrame:
    """Records of (path, content) rows; rows_a_frame bounds how many records leave a task at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    found = to_records(layout.decode(bytes(content)))
                except ValueError as e:
                    found = iter([{"error": str(e)}])
                batch: list[dict[str, Any]] = []
                for record in found:
                    batch.append(record)
                    if len(batch) == rows_a_frame:
                        yield _frame(batch, path=path)
                        batch = []
                if batch:
                    yield _frame(batch, path=path)

    return files.select("path", "content").mapInPandas(run, f"path string, {FIELDS}")


def write_region_files(records: DataFrame, layout: rg.Layout) -> DataFrame:
    """(path, content, error) of records with a path; a region's records meet in one task, as its file is one value."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made, error = None, None
        try:
            made = layout.encode(from_records([{k: _plain(v) for k, v in r.items()} for r in rows.to_dict("records")]))
        except ValueError as e:
            error = str(e)
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [made], "error": [error]})

    return records.where("error IS NULL").groupBy("path").applyInPandas(build, "path string, content binary, error string")


def _plain(v: Any) -> Any:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return int(v) if isinstance(v, float | np.integer) else v


def convert(files: DataFrame, source: rg.Layout, target: rg.Layout) -> DataFrame:
    """(path, content in the target layout, sizes, times, whether the reread result equals, error) of each file."""

    def one(content: bytes | None) -> dict[str, Any]:
        if content is None:
            return {"error": "no content"}
        try:
            clock = [time.perf_counter_ns()]
            region = source.decode(content)
            clock.append(time.perf_counter_ns())
            made = target.encode(region)
            clock.append(time.perf_counter_ns())
            again = target.decode(made)
            clock.append(time.perf_counter_ns())
            read_ns, write_ns, reread_ns = np.diff(clock).tolist()
            before, after = source.sizes(content), target.sizes(made)
            return {
                "content": made, "in_bytes": before.stored, "out_bytes": after.stored, "in_raw": before.raw, "out_raw": after.raw, "voxels": rg.voxels(region),
                "read_ns": read_ns, "write_ns": write_ns, "reread_ns": reread_ns, "same": rg.equal(region, again),
            }
        except ValueError as e:
            return {"in_bytes": len(content), "error": str(e)}

    return each_file(files.select("path", "content"), lambda row: one(row["content"]), OUTCOME)


def each_file(files: DataFrame, work: Callable[[dict[str, Any]], dict[str, Any]], fields: str) -> DataFrame:
    """All columns but content, and the fields that work makes of a row; content reaches it as bytes or None."""
    kinds = {f.split()[0]: f.split()[1] for f in fields.split(", ")}
    kept = [f for f in files.schema.fields if f.name != "content"]
    as_pandas = {"long": "Int64", "bigint": "Int64", "int": "Int64", "boolean": "boolean"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                row = {k: bytes(v) if k == "content" and v is not None else v if k == "content" else _plain(v) for k, v in row.items()}
                out = {f.name: (row[f.name], f.dataType.simpleString()) for f in kept}
                got = work(row)
                out |= {n: (got.get(n), k) for n, k in kinds.items()}
                yield pd.DataFrame({n: pd.Series([v], dtype=as_pandas.get(k, object)) for n, (v, k) in out.items()})

    return files.mapInPandas(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [fields]))


def convert_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files, failures, differing results, sizes, size ratio, and megabytes and voxels a second by phase."""
    sums = outcomes.agg(
        F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(~F.col("same")).alias("differing"),
        *(F.sum(c).alias(c) for c in ("in_bytes", "out_bytes", "in_raw", "out_raw", "voxels", "read_ns", "write_ns", "reread_ns")),
    )
    rate = lambda amount, ns, unit: F.try_divide(F.col(amount) * 1e9 / unit, F.col(ns))
    rates = [rate(a, f"{p}_ns", u).alias(f"{p}_{n}_s") for p in ("read", "write", "reread") for a, n, u in (("in_raw", "mb", 1e6), ("voxels", "voxels", 1.0))]
    return sums.select("*", F.try_divide(F.col("out_bytes") - F.col("in_bytes"), F.col("in_bytes")).alias("ratio"), *rates)


def pack_cells(cells: DataFrame) -> DataFrame:
    """Snapshot records of rows (path, dim, protocol, version, slot, domain, section, level, ts, atoms array<int>).

    Short atoms are filled with 0, as the format reads missing words; atoms beyond 16 bits raise.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.drop(columns="atoms").to_dict("records")
            for row, atoms in zip(rows, frame["atoms"], strict=True):
                full = np.zeros(rg.CELLS[row["domain"]], np.int64)
                full[: len(atoms)] = atoms
                if full.min() < 0 or full.max() > rg.UNCHANGED:
                    raise ValueError(f"atoms from {full.min()} to {full.max()} don't fit 16 bits")
                s = rg.pack(row["ts"], full)
                row |= {"record": "snapshot", "single": s.single, "palette": None if s.single is not None else list(s.palette), "words": None if s.single is not None else s.words}
            out = _frame(rows)
            out.insert(0, "path", frame["path"].to_numpy())
            yield out

    keep = ["path", "dim", "protocol", "version", "slot", "domain", "section", "level", "ts", "atoms"]
    return cells.select(*keep).mapInPandas(run, f"path string, {FIELDS}")


def snapshot_atoms(records: DataFrame) -> DataFrame:
    """(path, slot, domain, section, level, ts, atoms): the stored cells of each snapshot, sentinels included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["path", "slot", "domain", "section", "level", "ts"]].copy()
            rows = zip(frame["domain"], frame["single"], frame["palette"], frame["words"], strict=True)
            out["atoms"] = [rg.unpack(rg.Snapshot(0, int(v)) if p is None else rg.Snapshot(0, None, tuple(map(int, p)), bytes(w)), rg.CELLS[d]).tolist() for d, v, p, w in rows]
            yield out

    fields = "path string, slot int, domain string, section int, level int, ts long, atoms array<int>"
    return records.where("record = 'snapshot'").select("path", "slot", "domain", "section", "level", "ts", "single", "palette", "words").mapInPandas(run, fields)


def stream_table(files: DataFrame, layout: rg.Layout, level: int = 8) -> DataFrame:
    """(stream, files, snapshots, bytes, alone_bytes) over all files: what each columnar stream takes, also compressed alone.

    snapshots: packed snapshots of a bucket stream, null for others; the stream 'buckets' is all of these together. Files
    that can't be read don't count.
    """
    buckets = set(rg.STREAMS[7:16])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    region = layout.decode(bytes(content)) if content is not None else None
                except ValueError:
                    region = None
                if region is None:
                    continue
                rows = rg.stream_sizes(region, level, layout.modelled)
                counts = rg.bucket_counts(region, layout.modelled)
                made = [(name, counts.get(name) if name in buckets else None, n, alone) for name, n, alone in rows]
                yield pd.DataFrame(made, columns=["stream", "snapshots", "bytes", "alone_bytes"]).astype({"snapshots": "Int64"})

    each = files.select("content").mapInPandas(run, "stream string, snapshots long, bytes long, alone_bytes long")
    sums = [F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("snapshots", "bytes", "alone_bytes"))]
    return each.groupBy("stream").agg(*sums)

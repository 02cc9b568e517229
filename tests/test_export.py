"""Export of region files as chunk containers, against values worked out from the histories."""

import json

import numpy as np

from gridlore.functions import anvil, nbt
from gridlore.functions import regions as rg
from gridlore.sources import chunk_export as ex

ROWS = rg.Layout(b"rowgrid")


def full(dim: int, ts: int, block: int = 1, biome: int = 2) -> rg.Segment:
    s = rg.empty_segment(dim)
    for i in range(rg.SECTIONS[dim]):
        s.sections["block"][i] = [rg.Snapshot(ts, block)]
        s.sections["biome"][i] = [rg.Snapshot(ts, biome)]
    return s


def test_history_at():
    newest, changed = np.arange(64), np.where(np.arange(64) < 3, 9, rg.UNCHANGED)
    h = [rg.pack(30, newest), rg.pack(20, changed), rg.Snapshot(10, rg.UNCHANGED)]
    older = np.where(np.arange(64) < 3, 9, newest)
    for ts, want in ((5, older), (10, older), (25, older), (30, newest), (99, newest)):
        assert np.array_equal(ex.grid_at(h, ts, 64), want)
    assert ex.grid_at([], 1, 64) is None
    feeds = [(9, {1: (5, b"a"), 2: None}), (6, {1: None, 3: (7, b"c")}), (2, {3: None, 1: (8, b"d")})]
    assert [ex.tiles_at(feeds, t) for t in (9, 7, 3, 0)] == [{1: (5, b"a")}, {3: (7, b"c")}, {1: (8, b"d")}, {1: (8, b"d")}]
    assert ex.tiles_at([], 3) == {}


def test_nearest_time():
    s = full(1, 40)
    s.tiles = [(20, {})]
    assert [ex.nearest_time(s, t) for t in (30, 31, 0)] == [20, 40, 20]
    assert ex.nearest_time(rg.empty_segment(1), 7) == 7


def test_first_seen_packing():
    assert ex.pack_first_seen(np.full(4096, 7), 4) == ([7], [])
    palette, longs = ex.pack_first_seen(16 - np.arange(4096) % 17, 4)
    assert palette == list(range(16, -1, -1)) and len(longs) == -(-4096 // 12)
    assert [longs[0] >> 5 * i & 31 for i in range(12)] == list(range(12))
    assert len(ex.pack_first_seen(np.arange(64) % 5, 0)[1]) == -(-64 // 21)


def test_export(spark, tmp_path):
    (tmp_path / "769").mkdir()
    entries = {"blockstates": [(1, "oak_log[axis=y]"), (3, "mod:x")], "biome_properties": [(2, "plains")], "tile_entities": [(4, "chest")]}
    for name, rows in entries.items():
        (tmp_path / f"769/{name}.json").write_text(json.dumps({"entries": [{"id": i, "name": n} for i, n in rows]}))
    names = {769: ex.load_names(spark, str(tmp_path), 769)}
    good = rg.Region(1, 769, 8, {33: full(1, 50), 40: rg.empty_segment(1), 0: full(1, -3, 999, 998)})
    good.segments[33].sections["block"][2] = [rg.pack(60, np.arange(4096) % 3 + 1), rg.Snapshot(50, 3)]
    good.segments[33].tiles = [(55, {5 << 16 | 2 << 8 | 1: (4, b""), 7: (9, nbt.write_payload(nbt.Tag("compound", {"id": nbt.Tag("string", "own")})))})]
    broken = rg.Region(1, 769, 8, {0: full(1, 1)})
    broken.segments[0].tiles = [(1, {0: (4, b"\x63")})]
    files = [
        ("in/r.-1.2.region", ROWS.encode(good)), ("in/r.0.0.region", ROWS.encode(good)), ("in/x.region", ROWS.encode(good)), ("in/r.5.5.region", None),
        ("in/r.6.6.region", ROWS.encode(rg.Region(0, 769))), ("in/r.7.7.region", ROWS.encode(rg.Region(1, 1))), ("in/r.8.8.region", ROWS.encode(broken)), ("in/r.9.9.region", b"no"),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    done = spark.createDataFrame([("DIM-1/region/r.0.0.mca",)], "out_path string")
    made = ex.export_files(df, ROWS, 1, "region", "mca", 57, names, done)
    rows = {r.path: r for r in made.collect()}
    total = ex.export_summary(made).first()
    assert (total.files, total.made, total.skipped, total.failed) == (8, 1, 1, 6) and total.out_bytes == rows["in/r.-1.2.region"].out_bytes
    assert {p: r.outcome for p, r in rows.items()} == {p: "made" if i == 0 else "skipped" if i == 1 else "failed" for i, (p, _) in enumerate(files)}
    got = rows["in/r.-1.2.region"]
    assert got.out_path == "DIM-1/region/r.-1.2.mca" and got.out_bytes == len(got.content)
    chunks = anvil.read_region(bytes(got.content))
    assert {k: t for k, (t, _) in chunks.items()} == {(0, 0): 0, (1, 1): 55}  # nearest to 57: 55 of tiles; -3 is clamped
    value = nbt.read_root(chunks[1, 1][1]).value
    assert [value[k].value for k in ("DataVersion", "xPos", "zPos", "yPos")] == [4189, -31, 65, 0]
    sections = value["sections"].value[1]
    assert [s.value["Y"].value for s in sections] == list(range(16))
    assert sections[2].value["block_states"].value["palette"].value[1][0].value == {"Name": nbt.Tag("string", "mod:x")}  # at 57 the older state holds
    log = sections[0].value["block_states"].value["palette"].value[1][0].value
    assert log["Name"].value == "minecraft:oak_log" and log["Properties"].value == {"axis": nbt.Tag("string", "y")}
    tiles = [t.value for t in value["block_entities"].value[1]]
    assert [(t["id"].value, t["x"].value, t["y"].value, t["z"].value) for t in tiles] == [("own", 7, 0, 0), ("minecraft:chest", 1, 5, 2)]
    strange = nbt.read_root(chunks[0, 0][1]).value["sections"].value[1][0].value
    assert strange["block_states"].value["palette"].value[1][0].value["Name"].value == ":unknown"
    assert len(strange["SkyLight"].value) == ex.LIGHT
    without = ex.export_files(df.limit(0), ROWS, 1, "region", "mca", 57, names)
    assert without.count() == 0

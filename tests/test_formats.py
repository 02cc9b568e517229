import json
import struct
import zlib

import pytest

from gridlore.functions import anvil
from gridlore.sources import registry_json
from gridlore.streaming.ingest import ingest


def test_region_layout():
    a, b = zlib.compress(b"a" * 9000), zlib.compress(bytes(range(256)) * 64)
    data = anvil.write_region([(5, 3, 2000, b), (0, 0, 999, b"x"), (0, 0, 1000, a)])
    assert struct.unpack_from(">I", data, 0)[0] == 2 << 8 | 1 and struct.unpack_from(">I", data, 4 * 101)[0] >> 8 == 3
    assert struct.unpack_from(">IB", data, 2 * 4096) == (len(a), 2) and len(data) % 4096 == 0
    assert anvil.read_region(data) == {(0, 0): (1000, b"a" * 9000), (5, 3): (2000, bytes(range(256)) * 64)}


@pytest.mark.parametrize("chunk", [(32, 0, 1, b""), (0, 32, 1, b""), (0, 0, 1, bytes(anvil.TOO_LARGE))])
def test_region_rejects(chunk):
    with pytest.raises(ValueError):
        anvil.write_region([chunk])


def test_region_files(spark):
    rows = [(1, 0, 0, 5, 0, b"old"), (1, 0, 0, 6, 1, b"new"), (2, 40, 0, 5, 0, b"bad")]
    made = {r.region: r for r in anvil.region_files(spark.createDataFrame(rows, "region int, lx int, lz int, ts long, write_order int, payload binary"), "region").collect()}
    assert anvil.read_region(bytes(made[1].file)) == {(0, 0): (6, b"new")}
    assert made[2].file is None and "outside" in made[2].error


def test_registry_and_discovery(spark, tmp_path):
    (tmp_path / "765").mkdir()
    entries = [{"id": 1, "name": "oak_log[axis=y]"}, {"id": 70000, "name": "far"}, {"id": 2, "name": "x[-]"}]
    (tmp_path / "765/blockstates.json").write_text(json.dumps({"entries": entries}))
    got = {r.id: (r.name, r.properties) for r in registry_json.registry(spark, str(tmp_path), 765, "block").collect()}
    assert got == {1: ("oak_log", {"axis": "y"}), 2: ("x", {})}
    for name in ("r.5.7.region", "r.-1.-1.region", "notregion.region", "r.-1.-1.txt"):
        (tmp_path / "765" / name).write_bytes(b"x")
    found = {(r.path.rsplit("/", 1)[1], r.rx, r.rz) for r in registry_json.discover(spark, str(tmp_path), "region").collect()}
    assert found == {("r.5.7.region", 5, 7), ("r.-1.-1.region", -1, -1), ("notregion.region", None, None)}


def test_ingest(spark, tmp_path):
    schema = "entity long, ts long, cell string, value int, seq long"
    batches = [[(1, 10, "a", 1, 0), (1, 10, "b", 2, 1)], [(1, 5, "a", 9, 2), (1, 20, "a", 1, 3), (1, 30, "a", 4, 4)]]
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source) if not spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(source) else None
    spark.createDataFrame(batches[1], schema).coalesce(1).write.mode("append").parquet(source)
    query = ingest(stream).writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ts, r.status, r.changes, r.old) for r in spark.table("ingested").collect()}
    assert got == {(10, "accepted", 2, '{"a": null, "b": null}'), (5, "late", 0, "{}"), (20, "unchanged", 0, "{}"), (30, "accepted", 1, '{"a": 1}')}

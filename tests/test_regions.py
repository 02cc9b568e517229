"""Region layouts, their tables, and the entropy coders."""

import struct
import time
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import entropy as en
from gridlore.functions import regions as rg
from gridlore.sources import region_files as rf

ROWS, COLUMNAR = rg.Layout(b"rowgrid"), rg.Layout(b"colgrid", columnar=True)


def sample() -> rg.Region:
    """A segment with every kind of snapshot, one that is empty, a state log and tile feeds with an erase."""
    r = rg.Region(1, 769)
    a, b = rg.empty_segment(1), rg.empty_segment(1)
    rng = np.random.default_rng(7)
    a.sections["block"][12] = [rg.pack(42, np.arange(4096)), rg.pack(40, np.full(4096, 9)), rg.pack(7, rng.integers(0, 5, 4096))]
    a.sections["block"][0] = [rg.pack(-5, rng.integers(0, 200, 4096)), rg.pack(-6, np.where(np.arange(4096) < 9, 3, rg.UNCHANGED))]
    a.sections["biome"][3] = [rg.pack(8, np.arange(64)), rg.Snapshot(6, None, (5, 6, 5, 9), rg.pack_words(np.arange(64) % 3, 2))]
    a.sections["biome"][4] = [rg.Snapshot(1, None, (77,), bytes(8))]
    a.states, a.tiles = [(2, 9), (1, 7)], [(5, {1 << 16 | 3: (70000, b"\x0a\x00"), 2: None}), (4, {})]
    r.segments = {5: a, 1023: b}
    return r


@pytest.mark.parametrize("layout", [ROWS, COLUMNAR])
def test_layout_round_trip(layout):
    r = sample()
    data = layout.encode(r)
    again = layout.decode(data)
    assert rg.equal(r, again) and (again.dim, again.protocol) == (1, 769)
    assert layout.encode(again) == data
    assert layout.sizes(data).stored == len(data) < layout.sizes(data).raw
    other = layout.decode(data)
    other.segments[5].states[0] = (1, 9)
    assert not rg.equal(r, other)
    assert rg.equal(layout.decode(layout.encode(rg.Region(0, 1))), rg.Region(0, 1))


def test_known_bytes():
    """A region of one single-valued section, by hand from the layouts' definitions."""
    import zstandard

    r = rg.Region(2, 765, 8, {0: rg.empty_segment(2)})
    r.segments[0].sections["biome"][0] = [rg.Snapshot(7, 3)]
    body = lambda data: zstandard.ZstdDecompressor().decompress(data[11:])
    rows = ROWS.encode(r)
    assert rows[:11] == b"rowgrid" + bytes([8, 2]) + struct.pack("<H", 765)
    assert body(rows) == bytes(8) + b"\1" + bytes(8 * 16) + struct.pack("<QqBH", 1, 7, 0, 3) + bytes(8 * 15) + bytes(16) + bytes(1023)
    cols = COLUMNAR.encode(r)
    kinds = bytes([0b01000000]) + bytes(1024 * 16 // 4 - 1)
    assert cols[7:9] == bytes([1, 2])
    assert body(cols) == b"\x80" + bytes(127) + bytes(4096) + kinds + struct.pack("<H", 1) + bytes(4) + bytes(8) + bytes(2) + struct.pack("<qH", 7, 3) + bytes(4)


def test_columnar_palettes_are_ranked():
    again = COLUMNAR.decode(COLUMNAR.encode(sample())).segments[5]
    assert again.sections["biome"][3][1].palette == (5, 6, 5)  # 22, 21, 21 cells; the unused 9 goes
    assert again.sections["biome"][4][0].palette == (77,)
    assert again.sections["block"][12][0].palette == ()
    assert again.sections["block"][0][1].palette == (rg.UNCHANGED, 3)


def test_newest_snapshots():
    assert [len(h) for h in replace(ROWS, newest=1).decode(ROWS.encode(sample())).segments[5].sections["block"] if h] == [1, 1]


def test_refusals():
    data = ROWS.encode(sample())
    for bad in (b"", data[:9], b"x" + data[1:], data[:7] + b"\x09" + data[8:], data[:8] + b"\x03" + data[9:], data[:-20]):
        with pytest.raises(ValueError):
            ROWS.decode(bad)
    wrong = rg.Region(1, 1, 8, {0: rg.empty_segment(0)})
    beyond = rg.Region(1, 1, 8, {0: rg.empty_segment(1)})
    beyond.segments[0].sections["biome"][0] = [rg.Snapshot(1, None, (1, 2, 3), rg.pack_words(np.full(64, 3), 2))]
    for r in (wrong, beyond):
        with pytest.raises(ValueError):
            COLUMNAR.encode(r)


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_words(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 100)
    words = rg.pack_words(values, bits)
    assert len(words) == -(-100 * bits // 64) * 8 and np.array_equal(rg.unpack_words(words, bits, 100), values)
    assert int.from_bytes(words[:8], "little") == sum(int(v) << i * bits for i, v in enumerate(values[: 64 // bits]))


def test_tables(spark):
    r = sample()
    files = spark.createDataFrame([("a", ROWS.encode(r)), ("b", b"no"), ("c", None), ("d", ROWS.encode(rg.Region(0, 3)))], "path string, content binary")
    records = rf.read_region_files(files, ROWS, rows_a_frame=3)
    errors = {x.path: x.error for x in records.where("error IS NOT NULL").collect()}
    assert set(errors) == {"b", "c"}
    back = {x.path: x for x in rf.write_region_files(records, COLUMNAR).collect()}
    assert rg.equal(COLUMNAR.decode(bytes(back["a"].content)), r) and rg.equal(COLUMNAR.decode(bytes(back["d"].content)), rg.Region(0, 3)) and len(back) == 2
    done = rf.convert(files, ROWS, COLUMNAR)
    assert {x.path: (x.same, x.error is None) for x in done.collect()} == {"a": (True, True), "b": (None, False), "c": (None, False), "d": (True, True)}
    total = rf.convert_summary(done).first()
    assert (total.files, total.failed, total.differing, total.voxels) == (4, 2, 0, 2 * 16 * 4096)
    assert rf.convert_summary(done.limit(0)).first().files == 0


BYTES = [b"", b"a", b"ab", b"hello, world!", bytes(range(256)), b"x" * 5000, b"aaaaaaab" * 900, np.random.default_rng(3).bytes(9000)]


@pytest.mark.parametrize("data", BYTES, ids=lambda b: f"{len(b)}")
def test_coders(data):
    freq = en.frequencies(data)
    assert freq.sum() == (en.TOTAL if data else 0) and all((f > 0) == (b in data) for b, f in enumerate(freq))
    assert en.decode_bytes(en.encode_bytes(data, freq), len(data), freq) == data
    assert en.decode_adaptive(en.encode_adaptive(data), len(data)) == data


def test_coder_states():
    freq = en.frequencies(b"x" * 10)
    assert en.encode_bytes(b"x" * 10, freq) == struct.pack(">I", en.LOWEST)  # a sure symbol costs nothing
    assert en.frequencies(b"aab")[[97, 98]].tolist() == [2731, 1365]
    assert en.frequencies(b"ab" * 3 + b"c" * 3)[[97, 98, 99]].tolist() == [1365, 1365, 1366]  # ties: the highest byte
    coder = en.BitEncoder()
    coder.encode(2048, 1)
    assert coder.finish() == bytes(4)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4095), st.integers(0, 1)), max_size=300))
def test_bit_coder(pairs):
    coder = en.BitEncoder()
    for chance, bit in pairs:
        coder.encode(chance, bit)
    back = en.BitDecoder(coder.finish())
    assert [back.decode(chance) for chance, _ in pairs] == [bit for _, bit in pairs]


def test_round_trip_tables(spark):
    rows = spark.createDataFrame([(1, "text é"), (2, ""), (3, None)], "k int, text string")
    for coder in en.CODERS:
        assert {(r.k, r.bytes, r.restored) for r in en.round_trips(rows, "k", "text", coder).collect()} == {(1, 7, True), (2, 0, True), (3, None, None)}


def _bit_by_bit(data):
    coder, chances = en.BitEncoder(), [en.TOTAL // 2] * 256
    for b in data:
        for k in range(8):
            node, bit = (b | 256) >> 8 - k, b >> 7 - k & 1
            coder.encode(chances[node], bit)
            chances[node] += ((en.TOTAL - 1) * bit - chances[node]) >> 5
    return coder.finish()


def test_adaptive_lanes():
    r = np.random.default_rng(5)
    rare = [bytes(r.choice([0, 255], n, p=[0.998, 0.002]).astype(np.uint8)) for n in r.integers(0, 900, 80).tolist()]  # long codes of single bits
    words = [b" ".join(r.choice([b"grid", b"of", b"the", b"older", b"cells"], n).tolist()) for n in r.integers(0, 120, 120).tolist()]
    values = [*BYTES, *rare, *(r.bytes(n) for n in r.integers(0, 300, 80).tolist()), *words]
    codes = [_bit_by_bit(v) for v in values]
    assert [en.encode_adaptive(v) for v in values] == codes and en.encode_adaptive_all(values) == codes
    assert [en.decode_adaptive(c, len(v)) for c, v in zip(codes, values, strict=True)] == values
    assert en.decode_adaptive_all(codes, [len(v) for v in values]) == values
    cut, sizes = [c[: len(c) // 2] for c in codes], [len(v) for v in values]
    assert en.decode_adaptive_all(cut, sizes) == [en.decode_adaptive(c, n) for c, n in zip(cut, sizes, strict=True)]
    assert en.encode_adaptive_all([]) == en.decode_adaptive_all([], []) == []


def test_adaptive_is_side_by_side():
    r = np.random.default_rng(6)
    values = [bytes(r.choice(list(b"etaoin shrdlu"), n).astype(np.uint8)) for n in r.integers(500, 700, 2000).tolist()]
    trip = en.CODERS["adaptive"]
    began = time.process_time()
    assert [v for _, v in trip(values)] == values
    all_s, began = time.process_time() - began, time.process_time()
    assert [trip([v])[0][1] for v in values[:200]] == values[:200]
    assert all_s < 5 * (time.process_time() - began)  # of ten times as many values


def test_by_length(spark):
    texts = [None, "", "x" * 70000, *("y" * (n % 900) for n in range(6000)), *("é" * 20000 for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    held = en.by_length(rows, "k", "text").withColumn("part", F.spark_partition_id()).select("part", F.octet_length("text").alias("n")).toPandas()
    assert len(held) == len(texts) and held["n"].sum() == sum(len((t or "").encode()) for t in texts)
    parts = held.groupby("part")["n"].agg(["min", "max", "sum"]).sort_index()
    assert len(parts) >= 3 and parts["sum"].max() < 2.5 * en.LEAST_PART
    assert all(low * 1.25 >= high for low, high in zip(parts["min"], parts["max"].shift(-1).dropna(), strict=False))
    made = {r.k: (r.bytes, r.restored) for r in en.round_trips(rows, "k", "text", "adaptive").collect()}
    assert made == {k: (None, None) if t is None else (len(t.encode()), True) for k, t in enumerate(texts)}
    assert en.round_trips(rows.limit(0), "k", "text", "adaptive").collect() == []

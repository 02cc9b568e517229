import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlore.functions import nbt
from gridlore.functions.nbt import Tag

SAMPLE = Tag(
    "compound",
    {
        "bytes": Tag("byte_array", [1, -2, 3]),
        "n": Tag("int", 42),
        "s": Tag("string", "a\0é\U0001f600"),
        "in": Tag("compound", {"l": Tag("list", ["int", [Tag("int", 1), Tag("int", -1)]]), "w": Tag("long_array", [1 << 62, -1])}),
    },
)

leaves = st.one_of(
    st.integers(-128, 127).map(lambda v: Tag("byte", v)),
    st.integers(-(1 << 63), (1 << 63) - 1).map(lambda v: Tag("long", v)),
    st.floats(width=32, allow_nan=False).map(lambda v: Tag("float", v)),
    st.floats(allow_nan=False).map(lambda v: Tag("double", v)),
    st.text(max_size=20).map(lambda v: Tag("string", v)),
    st.lists(st.integers(-(1 << 31), (1 << 31) - 1), max_size=5).map(lambda v: Tag("int_array", v)),
    st.lists(st.integers(-5, 5).map(lambda v: Tag("short", v)), max_size=4).map(lambda v: Tag("list", ["short", v])),
)
documents = st.dictionaries(st.text(max_size=5), st.recursive(leaves, lambda c: st.dictionaries(st.text(max_size=5), c, max_size=3).map(lambda v: Tag("compound", v)), max_leaves=8), max_size=4).map(lambda v: Tag("compound", v))


def test_known_bytes():
    assert nbt.write_root(Tag("compound", {"a": Tag("short", 258)})) == b"\x0a\0\0\x02\0\x01a\x01\x02\0"
    assert nbt.write_payload(SAMPLE)[0] == 10 and b"a\xc0\x80\xc3\xa9\xed\xa0\xbd\xed\xb8\x80" in nbt.write_payload(SAMPLE)


@settings(max_examples=100, deadline=None)
@given(documents)
def test_round_trips(document):
    assert nbt.read_payload(nbt.write_payload(document)) == document
    assert nbt.read_root(nbt.write_root(document)) == document
    assert nbt.from_json(nbt.to_json(document)) == document


@pytest.mark.parametrize("data", [b"", b"\0", b"\0rest"])
def test_empty(data):
    assert nbt.read_payload(data) == Tag("compound", {})


@pytest.mark.parametrize("data", [b"\x0d", b"\x03\0", b"\x0a\x03\0", b"\x08\0\x05ab", b"\x09\0\0\0\0\x01", b"\x09" * 4 + b"\0\0\0\x01" * 9, (b"\x09" + b"\x09\0\0\0\x01" * 600)])
def test_bad_bytes(data):
    with pytest.raises(ValueError):
        nbt.read_payload(data)


def test_columns(spark):
    rows = [(1, nbt.write_payload(SAMPLE)), (2, None), (3, b""), (4, b"\x03\0")]
    made = {r.k: r for r in spark.createDataFrame(rows, "k int, p binary").select("k", nbt.payload_json("p").alias("d")).selectExpr("k", "d.json", "d.error").collect()}
    assert nbt.from_json(made[1].json) == SAMPLE and made[2].json is None and made[3].json == '{"compound":{}}'
    assert made[4].json is None and "bytes" in made[4].error and made[1].error is None
    back = spark.createDataFrame([(made[1].json,), (None,)], "j string").select(nbt.json_root("j").alias("b")).collect()
    assert {None if r.b is None else bytes(r.b) for r in back} == {nbt.write_root(SAMPLE), None}


def test_tile_entities(spark):
    stored = nbt.write_payload(Tag("compound", {"id": Tag("string", "own:id"), "Items": Tag("list", ["end", []])}))
    rows = [(1, "chest", 1, 2, 3, -4, None), (2, "a:b", 1, 2, 3, -4, stored), (3, None, None, None, None, None, nbt.write_payload(Tag("int", 1))), (4, "x", 7, 8, 9, 0, b"\x03")]
    tiles = spark.createDataFrame(rows, "k int, name string, x int, y int, z int, low int, p binary")
    columns = [tiles[c] for c in ("name", "x", "y", "z", "low", "p")]
    made = {r.k: r for r in tiles.select("k", nbt.tile_entity_json(*columns).alias("d")).selectExpr("k", "d.*").collect()}
    fields = {k: nbt.from_json(r.json).value for k, r in made.items() if r.json}
    assert fields[1] == {"id": Tag("string", "minecraft:chest"), "keepPacked": Tag("byte", 0), "x": Tag("int", 1), "y": Tag("int", -62), "z": Tag("int", 3)}
    assert fields[2] == fields[1] | {"id": Tag("string", "own:id"), "Items": Tag("list", ["end", []])}
    assert fields[3]["id"] == Tag("string", ":unknown") and fields[3]["y"] == Tag("int", 0)
    assert made[4].json is None and made[4].error.startswith("tile entity at (7,8,9)")

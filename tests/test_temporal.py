"""Behaviour at the edges: clamps, ties, no-ops, erases."""

from gridlore.operators import temporal as t
from gridlore.operators.ordering import row_numbers, sample_evenly


def hist(spark):
    return spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "k int, ts long, v int")


def test_asof_clamps(spark):
    got = [t.asof(hist(spark), ["k"], "ts", "v", at).first().v for at in (5, 10, 25, 30, 99)]
    assert got == [1, 1, 2, 3, 3]


def test_nearest_prefers_newer(spark):
    assert [t.nearest_ts(hist(spark), ["k"], "ts", at).first().nearest for at in (25, 5)] == [30, 10]


def test_asof_join(spark):
    probes = spark.createDataFrame([(1, 5), (1, 20), (1, 99), (2, 1)], "k int, ts long")
    got = {(r.k, r.ts): r.v for r in t.asof_join(probes, hist(spark), ["k"], "ts", "v").collect()}
    assert got == {(1, 5): 1, (1, 20): 2, (1, 99): 3, (2, 1): None}


def test_keyed_diff(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in t.keyed_diff(a, b, ["k"], "v").collect()} == {("c", "erase", None), ("b", "put", 2)}


def test_keyed_replay_at_every_level(spark):
    """Against the replay level by level, beyond the four levels of keyed_replay_all; each key has its own number of levels."""
    ops = ["erase put put put erase put put put erase put".split(), ["put"] * 6, ["erase"], ["erase", "put"]]
    rows = [(k, level, (level * level + k) % 3, op, 100 * k + level) for k, of_key in enumerate(ops) for level, op in enumerate(of_key)]
    rows += [(1, 2, 7, "put", 27), (1, 4, 7, "erase", 0)]  # several positions in one level
    want = []
    for k, of_key in enumerate(ops):
        now = {}
        for at in range(len(of_key)):
            for _, _, pos, op, value in (r for r in rows if r[:2] == (k, at)):
                now.pop(pos, None) if op == "erase" else now.update({pos: value})
            want += [(k, at, pos, value) for pos, value in now.items()]
    feed = spark.createDataFrame(rows, "k int, level int, pos int, op string, value int")
    got = t.replay_levels(feed, ["k"], "pos")
    assert got.columns == ["k", "at", "pos", "value"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(at for _, at, _, _ in want) == 9


def test_state_log(spark):
    log = spark.createDataFrame([(1, 1, "New", 1), (1, 2, "New", 2), (1, 3, "Old", 3), (1, 3, "New", 4)], "k int, ts long, s string, tie int")
    assert [(r.ts, r.s) for r in t.state_log(log, ["k"], "ts", "s", "tie").orderBy("ts").collect()] == [(1, "New"), (3, "Old")]


def test_round_trip_and_no_ops(spark):
    rows = [(1, 1, 0, 5), (1, 1, 1, 6), (1, 2, 0, 5), (1, 2, 1, 6), (1, 3, 0, 7), (1, 3, 1, 6)]
    grid = t.drop_unchanged(spark.createDataFrame(rows, "e int, ts long, pos int, atom int"), "e", "ts")
    enc = t.reverse_delta(grid, "e", "ts")
    back = t.reconstruct(enc, "e").select("ts", "pos", "atom")
    assert {tuple(r) for r in back.collect()} == {r[1:] for r in rows if r[1] != 2}
    assert {tuple(r) for r in enc.where("level = 1").select("pos", "enc").collect()} == {(0, 5), (1, 65535)}


def test_sample_evenly(spark):
    df = spark.range(10).withColumnRenamed("id", "doc")
    assert sorted(r.doc for r in sample_evenly(df, "doc", 3).collect()) == [0, 3, 6]
    assert sample_evenly(df, "doc", 20).count() == 10
    assert sorted((r.doc, r.idx) for r in row_numbers(df, "doc").collect()) == [(i, i) for i in range(10)]


def test_empty(spark):
    none = spark.createDataFrame([], "k int, ts long, v int")
    assert t.asof(none, ["k"], "ts", "v", 1).count() == 0
    assert row_numbers(none, "ts").count() == 0


def test_state_log_with_several_states_of_one_time(spark):
    """Against the rule applied row by row, batch and stream."""
    import random

    rng = random.Random(4)
    rows = [(k, rng.randrange(12), i, rng.choice("abc")) for i, k in enumerate(k for k in range(40) for _ in range(20))]
    want = []
    for k in range(40):
        last = None
        for _, at, _, now in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or (at > last[0] and now != last[1]):
                last = (at, now)
                want.append((k, at, now))
    df = spark.createDataFrame(rows, "k int, ts long, tie int, s string").repartition(3)
    assert sorted(map(tuple, t.state_log(df, ["k"], "ts", "s", "tie").collect())) == sorted(want)
    assert t.state_log(df.where("1 = 0"), ["k"], "ts", "s", "tie").count() == 0

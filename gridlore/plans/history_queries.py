"""Temporal queries over the event and order tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as t
from ..streaming import ingest
from ..streaming.progress import drained

#: Probe times in microseconds: 2024-01-05, 2024-01-10, and 2024-01-15 UTC.
T0, T1, T2 = 1704412800000000, 1704844800000000, 1705276800000000
#: A probe day among the orders: 1996-01-01 UTC.
T_ORDER = 820454400000000
CELLS = ("click", "error", "purchase", "signup", "view")
KEYS = ["user_id", "event_type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section history: entity user_id, cell event_type, ts, atom."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", t.micros("ts").alias("ts"), F.floor("value").cast("int").alias("atom"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", t.micros("o_orderdate").alias("ts"), "o_orderstatus")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.drop_unchanged(t.carry_grid(history(spark, sf_dir), "user_id", "event_type", CELLS, "ts", "atom"), "user_id", "ts")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed change feed: position event_id % 8, an error erases."""
    h = t.with_level(history(spark, sf_dir), ["user_id"], "ts")
    op = F.when(F.col("event_type") == "error", "erase").otherwise("put")
    return h.select("user_id", "level", (F.col("event_id") % 8).cast("int").alias("pos"), op.alias("op"), F.col("atom").alias("value"))


H = "h AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS ts, CAST(floor(value) AS INT) AS atom FROM events)"
S = "s AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS ts, o_orderstatus FROM orders)"
LOG = f"""RECURSIVE {S}, f AS (SELECT o_custkey, ts, arg_min(o_orderstatus, o_orderkey) AS a FROM s GROUP BY 1, 2),
g AS (SELECT o_custkey, ts, a, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> a) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY ts) AS i FROM f JOIN s USING (o_custkey, ts) GROUP BY 1, 2, 3),
w AS (SELECT o_custkey, ts, i, a AS state, true AS taken FROM g WHERE i = 1
 UNION ALL SELECT g.o_custkey, g.ts, g.i, CASE WHEN g.a <> w.state THEN g.a ELSE coalesce(g.b, w.state) END, g.a <> w.state OR g.b IS NOT NULL FROM w JOIN g ON g.o_custkey = w.o_custkey AND g.i = w.i + 1),
log AS (SELECT o_custkey, ts, state AS o_orderstatus FROM w WHERE taken)"""


def asof_sql(at: int, keys: str = "user_id, event_type") -> str:
    return f"SELECT {keys}, coalesce(arg_max(atom, ts) FILTER (ts <= {at}), arg_min(atom, ts)) AS atom FROM h GROUP BY {keys}"


_CARRY = ", ".join(
    f"coalesce(last_value(CASE WHEN event_type = '{c}' THEN atom END IGNORE NULLS) OVER w, 0) AS c{i}" for i, c in enumerate(CELLS)
)
GRID = f"""{H}, wide AS (SELECT user_id, ts, {_CARRY} FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (SELECT * FROM wide WINDOW u AS (PARTITION BY user_id ORDER BY ts) QUALIFY lag(ts) OVER u IS NULL OR (c0, c1, c2, c3, c4) IS DISTINCT FROM (lag(c0) OVER u, lag(c1) OVER u, lag(c2) OVER u, lag(c3) OVER u, lag(c4) OVER u)),
grid AS ({' UNION ALL '.join(f'SELECT user_id, ts, {i} AS pos, c{i} AS atom FROM kept' for i in range(5))})"""
ENC = f"""{GRID}, enc AS (SELECT user_id, ts, pos, row_number() OVER n - 1 AS level,
 CASE WHEN lag(atom) OVER n IS NULL OR lag(atom) OVER n <> atom THEN atom ELSE 65535 END AS enc FROM grid WINDOW n AS (PARTITION BY user_id, pos ORDER BY ts DESC))"""
FEED = f"""{H}, feed AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS level, event_id % 8 AS pos,
 CASE WHEN event_type = 'error' THEN 'erase' ELSE 'put' END AS op, atom AS value FROM h)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d)
    last = lambda lo, hi: h.where((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy(*KEYS).agg(F.max_by("atom", "ts").alias("atom"))
    return t.keyed_diff(last(T0, T1), last(T1, T2), KEYS, "atom")


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        states(spark, d).select(F.col("o_custkey").alias("id"), "ts"),
        history(spark, d).select(F.col("user_id").alias("id"), "ts"),
        table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), t.micros("l_shipdate").alias("ts")),
    ]
    return t.chunk_timestamp(t.timeline([p.withColumn("ts", F.floor(F.col("ts") / 1000000).cast("long")) for p in parts]), ["id"], "ts", T1 // 1000000)


def _update(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d)
    return t.update_changes(t.asof(h, KEYS, "ts", "atom", T1), t.asof(h, KEYS, "ts", "atom", T2), "user_id", "event_type", "atom")


def _asof_join(spark: SparkSession, d: str) -> DataFrame:
    days = F.array(*[F.lit(T_ORDER + k * 86400000000 * 180).cast("long") for k in range(3)])
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(days).alias("ts"))
    log = t.state_log(states(spark, d), ["o_custkey"], "ts", "o_orderstatus", "o_orderkey")
    return t.asof_join(probes, log, ["o_custkey"], "ts", "o_orderstatus")


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    back = t.reconstruct(t.reverse_delta(g, "user_id", "ts"), "user_id").select("user_id", "ts", "pos", "atom")
    cols = ["user_id", "ts", "pos", "atom"]
    tagged = g.select(*cols, F.lit(1).alias("side")).unionAll(back.select(*cols, F.lit(-1).alias("side")))
    # Multiset equality as one aggregate: every distinct row must cancel out.
    return tagged.groupBy(*cols).agg(F.sum("side").alias("s")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("s") != 0).alias("n_different"))


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.readStream.schema(table(s, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """All events as one stream that ends; within a micro-batch snapshots arrive in the order of their time."""
    e = _stream(s, d, "events").select(F.col("user_id").alias("entity"), t.micros("ts").alias("ts"), F.col("event_type").alias("cell"), F.floor("value").cast("int").alias("value"))
    return drained(ingest.ingest(e.withColumn("seq", F.col("ts"))), "ingest").select("entity", "ts", "status", "changes")


def _streamed_states(s: SparkSession, d: str) -> DataFrame:
    o = _stream(s, d, "orders").select(F.col("o_custkey").alias("entity"), t.micros("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("seq"))
    return drained(ingest.state_log(o), "state-log")


QUERIES = {
    "asof_clamp": lambda s, d: t.asof(history(s, d), KEYS, "ts", "atom", T1),
    "asof_join": _asof_join,
    "latest_per_key": lambda s, d: history(s, d).groupBy(*KEYS).agg(F.max_by("atom", "ts").alias("atom")),
    "delta_i": lambda s, d: t.with_level(history(s, d), KEYS, "ts").where("level = 1").select(*KEYS, "ts", "atom"),
    "reverse_delta_encode": lambda s, d: t.reverse_delta(grid(s, d), "user_id", "ts"),
    "reconstruct_history": lambda s, d: t.reconstruct(t.reverse_delta(grid(s, d), "user_id", "ts"), "user_id"),
    "change_counts": lambda s, d: t.change_counts(t.reverse_delta(grid(s, d), "user_id", "ts"), "user_id", "ts"),
    "nearest_ts": lambda s, d: t.nearest_ts(history(s, d), ["user_id"], "ts", T1),
    "snapshot_nearest": lambda s, d: t.snapshot_nearest(history(s, d), ["user_id"], "ts", "atom", T1),
    "newest_k": lambda s, d: t.newest_k(history(s, d), KEYS, "ts", 3).select(*KEYS, "ts", "atom", "level"),
    "state_log_dedupe": lambda s, d: t.state_log(states(s, d), ["o_custkey"], "ts", "o_orderstatus", "o_orderkey").select("o_custkey", "ts", "o_orderstatus"),
    "state_asof": lambda s, d: t.state_asof(t.state_log(states(s, d), ["o_custkey"], "ts", "o_orderstatus", "o_orderkey"), ["o_custkey"], "ts", "o_orderstatus", T_ORDER),
    "keyed_diff": _diff,
    "keyed_replay": lambda s, d: t.keyed_replay(feed(s, d), ["user_id"], "pos", 3),
    "keyed_replay_all": lambda s, d: t.replay_all(feed(s, d), ["user_id"], "pos", 4),
    "keyed_replay_levels": lambda s, d: t.replay_levels(feed(s, d), ["user_id"], "pos"),
    "complete_asof": lambda s, d: t.complete_asof(history(s, d), "user_id", "event_type", 5, "ts", "atom", T1),
    "complete_nearest": lambda s, d: t.complete_nearest(history(s, d), "user_id", "event_type", 5, "ts", "atom", T1),
    "complete_latest": lambda s, d: t.complete_latest(history(s, d), "user_id", "event_type", 5, "ts", "atom"),
    "stream_ingest": lambda s, d: _ingested(s, d),
    "stream_state_log": lambda s, d: _streamed_states(s, d),
    "min_latest": lambda s, d: t.min_latest(history(s, d), "user_id", "event_type", 5, "ts"),
    "update_changes": _update,
    "timeline_concat": _timeline,
    "semantic_equal": _semantic,
}

SQL = {
    "asof_clamp": f"WITH {H} {asof_sql(T1)}",
    "asof_join": f"""WITH {LOG}, probes AS (SELECT c_custkey AS o_custkey, unnest([{', '.join(str(T_ORDER + k * 86400000000 * 180) for k in range(3))}]) AS ts FROM customer)
SELECT p.o_custkey, p.ts, coalesce((SELECT arg_max(l.o_orderstatus, l.ts) FROM log l WHERE l.o_custkey = p.o_custkey AND l.ts <= p.ts),
 (SELECT arg_min(l.o_orderstatus, l.ts) FROM log l WHERE l.o_custkey = p.o_custkey)) AS o_orderstatus FROM probes p""",
    "latest_per_key": f"WITH {H} SELECT user_id, event_type, arg_max(atom, ts) AS atom FROM h GROUP BY 1, 2",
    "delta_i": f"WITH {H} SELECT user_id, event_type, ts, atom FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 2",
    "reverse_delta_encode": f"WITH {ENC} SELECT user_id, ts, pos, CAST(level AS INT) AS level, enc FROM enc",
    "reconstruct_history": f"WITH {GRID} SELECT user_id, ts, pos, CAST(row_number() OVER (PARTITION BY user_id, pos ORDER BY ts DESC) - 1 AS INT) AS level, atom FROM grid",
    "change_counts": f"""WITH {GRID} SELECT user_id, ts, CASE WHEN count(b) = 0 THEN count(*) ELSE count(*) FILTER (atom <> b) END AS changes
FROM (SELECT *, lag(atom) OVER (PARTITION BY user_id, pos ORDER BY ts) AS b FROM grid) GROUP BY user_id, ts""",
    "nearest_ts": f"WITH {H} SELECT user_id, ts AS nearest FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(ts - {T1}), ts DESC) = 1",
    "snapshot_nearest": f"WITH {H} SELECT user_id, ts AS nearest, atom FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(ts - {T1}), ts DESC) = 1",
    "newest_k": f"WITH {H}, l AS (SELECT user_id, event_type, ts, atom, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) - 1 AS INT) AS level FROM h) SELECT * FROM l WHERE level < 3",
    "state_log_dedupe": f"WITH {LOG} SELECT o_custkey, ts, o_orderstatus FROM log",
    "state_asof": f"WITH {LOG} SELECT o_custkey, CAST({T_ORDER} AS BIGINT) AS ts, coalesce(arg_max(o_orderstatus, ts) FILTER (ts <= {T_ORDER}), arg_min(o_orderstatus, ts)) AS o_orderstatus FROM log GROUP BY o_custkey",
    "keyed_diff": f"""WITH {H}, a AS (SELECT user_id, event_type, arg_max(atom, ts) AS was FROM h WHERE ts >= {T0} AND ts < {T1} GROUP BY 1, 2),
b AS (SELECT user_id, event_type, arg_max(atom, ts) AS now FROM h WHERE ts >= {T1} AND ts < {T2} GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN was IS NULL THEN 'erase' ELSE 'put' END AS op, was AS atom FROM a FULL JOIN b USING (user_id, event_type) WHERE was IS DISTINCT FROM now""",
    "keyed_replay": f"WITH {FEED} SELECT user_id, pos, value FROM (SELECT * FROM feed WHERE level <= 3 AND NOT (level = 0 AND op = 'erase') QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY level DESC) = 1) WHERE op = 'put'",
    "keyed_replay_all": f"""WITH {FEED} SELECT user_id, "at", pos, value FROM (SELECT feed.*, l."at" FROM feed JOIN range(4) AS l("at") ON level <= l."at" AND NOT (level = 0 AND op = 'erase')
QUALIFY row_number() OVER (PARTITION BY user_id, l."at", pos ORDER BY level DESC) = 1) WHERE op = 'put'""",
    "keyed_replay_levels": f"""WITH {FEED}, levels AS (SELECT user_id, level AS "at" FROM feed) SELECT user_id, "at", pos, value
FROM (SELECT feed.*, l."at" FROM feed JOIN levels l ON feed.user_id = l.user_id AND level <= l."at" AND NOT (level = 0 AND op = 'erase')
QUALIFY row_number() OVER (PARTITION BY feed.user_id, l."at", pos ORDER BY level DESC) = 1) WHERE op = 'put'""",
    "complete_asof": f"WITH {H}, a AS ({asof_sql(T1)}) SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY user_id) = 5",
    "complete_nearest": f"""WITH {H}, a AS (SELECT user_id, event_type, ts AS nearest, atom FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(ts - {T1}), ts DESC) = 1)
SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY user_id) = 5""",
    "complete_latest": f"""WITH {H}, a AS (SELECT user_id, event_type, atom, ts FROM h QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, atom DESC) = 1)
SELECT user_id, event_type, atom, min(ts) OVER (PARTITION BY user_id) AS min_latest FROM a QUALIFY count(*) OVER (PARTITION BY user_id) = 5""",
    "stream_ingest": f"""WITH {H}, g AS (SELECT user_id, event_type, ts, atom, lag(atom) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS was FROM h)
SELECT user_id AS entity, ts, CASE WHEN count(*) FILTER (was IS DISTINCT FROM atom) = 0 THEN 'unchanged' ELSE 'accepted' END AS status, CAST(count(*) FILTER (was IS DISTINCT FROM atom) AS INT) AS changes FROM g GROUP BY 1, 2""",
    "stream_state_log": f"WITH {LOG} SELECT o_custkey AS entity, ts, o_orderstatus AS state FROM log",
    "min_latest": f"WITH {H}, l AS (SELECT user_id, event_type, max(ts) AS latest FROM h GROUP BY 1, 2) SELECT user_id, min(latest) AS min_latest FROM l GROUP BY 1 HAVING count(*) = 5",
    "update_changes": f"WITH {H}, a AS ({asof_sql(T1)}), b AS ({asof_sql(T2)}) SELECT user_id, count(*) FILTER (a.atom <> b.atom) AS changes FROM a JOIN b USING (user_id, event_type) GROUP BY user_id",
    "timeline_concat": f"""WITH u AS (SELECT o_custkey AS id, epoch_us(o_orderdate) // 1000000 AS ts, 0 AS o FROM orders UNION ALL SELECT user_id, epoch_us(ts) // 1000000, 1 FROM events
UNION ALL SELECT l_suppkey, epoch_us(l_shipdate) // 1000000, 2 FROM lineitem)
SELECT id, least(greatest(ts, 0), 4294967295) AS chunk_ts FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(ts - {T1 // 1000000}), o, ts DESC) = 1""",
    "semantic_equal": f"WITH {GRID} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM grid",
}

"""Dictionary and grid queries over embeddings, read as 4 x 4 x 4 tiles of 64 cells, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as di
from ..operators import grid as g
from ..operators.ordering import running_sum
from .history_queries import table

CELLS = 64


def cells(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """(vec_id, pos, atom)"""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", F.floor((F.col("x").cast("double") + 1) * k).cast("int").alias("atom"))


C = "c AS (SELECT vec_id, pos - 1 AS pos, CAST(floor((CAST(embedding[pos] AS DOUBLE) + 1) * 16) AS INT) AS atom FROM embeddings, range(1, 65) AS r(pos))"
PAL = f"""{C}, n AS (SELECT vec_id, atom, count(*) AS n, min(pos) AS f FROM c GROUP BY 1, 2),
p AS (SELECT vec_id, atom, n, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, f) - 1 AS rk, count(*) OVER (PARTITION BY vec_id) AS size FROM n),
pal AS (SELECT *, CASE WHEN size <= 2 THEN 1 WHEN size <= 4 THEN 2 WHEN size <= 16 THEN 4 WHEN size <= 256 THEN 8 ELSE 16 END AS bits FROM p)"""
PACKED = f"""{PAL}, u AS (SELECT vec_id, bits, pos // (64 // bits) AS word_no, bit_or(CAST(rk AS UBIGINT) << CAST((pos % (64 // bits)) * bits AS UBIGINT)) AS w
FROM c JOIN pal USING (vec_id, atom) GROUP BY 1, 2, 3),
words AS (SELECT vec_id, bits, word_no, CASE WHEN w >= 9223372036854775808 THEN CAST(CAST(w AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(w AS BIGINT) END AS word FROM u)"""
XYZ = "pos % 4 AS x, pos // 16 AS y, pos // 4 % 4 AS z"
_AT = lambda name, dx, dy, dz: f"LEFT JOIN xyz {name} ON {name}.vec_id = a.vec_id AND {name}.x = a.x + ({dx}) AND {name}.y = a.y + ({dy}) AND {name}.z = a.z + ({dz})"


def _packed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cells(s, d)
    p = di.palette(c, "vec_id")
    return di.pack(c, p, "vec_id"), p


def _slots(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select((F.col("user_id") % 7).alias("area"), F.floor(F.col("user_id") / 7).cast("int").alias("slot"), "event_type", "value")


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


def _near_sql() -> str:
    """nb: the cells with their twelve neighbours v0 to v11."""
    names = [f"n{i}" for i in range(len(g.REACH))]
    joins = " ".join(_AT(n, *o) for n, o in zip(names, g.REACH, strict=True))
    return f"xyz AS (SELECT *, {XYZ} FROM c), nb AS (SELECT a.vec_id, a.pos, a.atom, {', '.join(f'coalesce({n}.atom, 65535) AS v{i}' for i, n in enumerate(names))} FROM xyz a {joins})"


def _vote_sql(least: int) -> str:
    lists = " UNION ALL ".join(f"SELECT vec_id, pos, atom, {i} AS i, {w} AS w, v{i} AS v FROM nb" for i, w in enumerate(g.VOTES))
    return f"""WITH {C}, {_near_sql()},
l AS ({lists}), votes AS (SELECT vec_id, pos, atom, v, min(i) AS i, max(i) AS last, CASE WHEN v = 65535 THEN -1 ELSE sum(w) END AS votes, count(*) AS k FROM l GROUP BY 1, 2, 3, 4),
members AS (SELECT vec_id, atom AS v FROM c GROUP BY 1, 2 HAVING count(*) >= {least}),
best AS (SELECT votes.* FROM votes LEFT JOIN members USING (vec_id, v) QUALIFY row_number() OVER (PARTITION BY votes.vec_id, pos ORDER BY CASE WHEN members.v IS NULL THEN 0 ELSE 1 END DESC, votes DESC, last, i) = 1),
m AS (SELECT best.vec_id, best.pos, best.atom, best.v AS primary_value, CAST(coalesce(sum(votes.k) FILTER (votes.v <> 65535 AND votes.v <> best.v), 0) AS INT) AS mismatches
FROM best JOIN votes USING (vec_id, pos) GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN mismatches = 0 THEN 0 WHEN mismatches = 1 THEN 1 WHEN mismatches <= 3 THEN 2 ELSE 3 END AS band FROM m"""


def _keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id")


def _names(s: SparkSession) -> DataFrame:
    return s.range(0, 32, 3).select(F.col("id").cast("int").alias("atom"), (F.col("id") * 5 + 1).cast("int").alias("value"))


def _region_cells(s: SparkSession, d: str) -> DataFrame:
    at = g.region_position(F.col("pos"), (F.col("vec_id") % 1024).cast("int"), F.floor(F.col("vec_id") / 1024).cast("int"), 4)
    return cells(s, d).select("vec_id", "pos", at.alias("place"))


SPARSE = "atom % 3 <> 0"


def _xyz(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    x, y, z = g.coordinates(F.col("pos"), 4)
    c = c.select("vec_id", "pos", x.alias("x"), y.alias("y"), z.alias("z"))
    slot = (F.col("vec_id") % 1024).cast("int")
    return c.withColumn("pos_back", g.position(F.col("x"), F.col("y"), F.col("z"), 4)).select("*", *g.tile_origin(slot, F.col("pos") % 24))


QUERIES = {
    "palette": lambda s, d: di.palette(cells(s, d), "vec_id"),
    "bit_pack": lambda s, d: _packed(s, d)[0],
    "bit_unpack": lambda s, d: di.unpack(*_packed(s, d), "vec_id", CELLS),
    "packed_histogram": lambda s, d: di.packed_histogram(_packed(s, d)[0], "vec_id", CELLS),
    "global_palette": lambda s, d: di.global_palette(cells(s, d, 64)),
    "rank_atoms": lambda s, d: di.rank_atoms(cells(s, d, 64)),
    "first_seen_palette": lambda s, d: di.palette(cells(s, d), "vec_id", "seen").select("vec_id", "atom", "rk", F.greatest(di.bit_length(F.col("size")), F.lit(4)).cast("int").alias("width")),
    "classify_tiles": lambda s, d: di.classify(cells(s, d, 4), "vec_id"),
    "presence_bitmap": lambda s, d: di.bitmap(_slots(s, d).select("area", "slot").distinct(), "area", "slot"),
    "descriptor_stats": lambda s, d: di.descriptors(_slots(s, d), "area", "slot", F.when(F.col("value") < 50, 1).otherwise(2)),
    "prefix_offsets": lambda s, d: running_sum(_lengths(s, d), "doc_id", F.col("bytes"), "start"),
    "sector_alloc": lambda s, d: running_sum(_lengths(s, d).withColumn("sectors", F.ceil((F.col("bytes") + 5) / 4096)), "doc_id", F.col("sectors"), "before").select("doc_id", "sectors", (F.col("before") + 2).alias("sector")),
    "cell_index": _xyz,
    "neighbors": lambda s, d: g.neighbours(cells(s, d), "vec_id", 4),
    "primary_vote": lambda s, d: g.primary_vote(cells(s, d), "vec_id", 4),
    "primary_vote_members": lambda s, d: g.primary_vote(cells(s, d), "vec_id", 4, least=5),
    "cell_read": lambda s, d: g.read_cell(cells(s, d).where(SPARSE), "vec_id", F.col("vec_id") % 64, CELLS),
    "cell_write": lambda s, d: g.write_cell(cells(s, d), F.col("vec_id") % 64, F.lit(99)),
    "constant_grid": lambda s, d: g.constant(_keys(s, d), "vec_id", CELLS, F.col("vec_id") % 9),
    "region_cells": _region_cells,
    "substitute": lambda s, d: di.substitute(cells(s, d), _names(s)),
    "classify_absent": lambda s, d: di.classify(cells(s, d, 2).where("pos < 3 AND atom = 1 + vec_id % 3"), "vec_id", _keys(s, d)),
    "rank_grid": lambda s, d: g.rank_grid(cells(s, d).where(SPARSE), "vec_id", CELLS),
    "fill_grid": lambda s, d: g.fill_grid(cells(s, d).where(SPARSE), "vec_id", CELLS, 0),
    "voxel_count": lambda s, d: table(s, d, "embeddings").groupBy("label").agg((F.count("*") * CELLS).alias("voxels")),
}

SQL = {
    "palette": f"WITH {PAL} SELECT vec_id, atom, n, CAST(rk AS INT) AS rk, CAST(size AS INT) AS size, bits FROM pal",
    "bit_pack": f"WITH {PACKED} SELECT vec_id, bits, CAST(word_no AS INT) AS word_no, word FROM words",
    "bit_unpack": f"WITH {C} SELECT vec_id, CAST(pos AS INT) AS pos, atom FROM c",
    "packed_histogram": f"WITH {PAL} SELECT vec_id, CAST(rk AS INT) AS rk, n FROM pal",
    "global_palette": f"WITH {C.replace('* 16', '* 64')} SELECT atom, CAST(row_number() OVER (ORDER BY atom) - 1 AS INT) AS id FROM (SELECT DISTINCT atom FROM c)",
    "rank_atoms": f"WITH {C.replace('* 16', '* 64')} SELECT atom, n, CAST(row_number() OVER (ORDER BY n DESC, atom) - 1 AS INT) AS rank FROM (SELECT atom, count(*) AS n FROM c GROUP BY 1)",
    "first_seen_palette": f"WITH {PAL} SELECT vec_id, atom, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY f) - 1 AS INT) AS rk, greatest(CAST(ceil(log2(count(*) OVER (PARTITION BY vec_id))) AS INT), 4) AS width FROM n",
    "classify_tiles": f"WITH {C.replace('* 16', '* 4')} SELECT vec_id, CASE WHEN count(DISTINCT atom) = 1 THEN 'uniform' ELSE 'palette' END AS kind, list_sort(list(DISTINCT atom)) AS entries, CAST(ceil(log2(count(DISTINCT atom))) AS INT) AS depth FROM c GROUP BY 1",
    "presence_bitmap": "WITH s AS (SELECT DISTINCT user_id % 7 AS area, user_id // 7 AS slot FROM events) SELECT area, CAST(slot // 8 AS INT) AS byte_no, CAST(bit_or(1 << CAST(7 - slot % 8 AS INT)) AS INT) AS bits FROM s GROUP BY 1, 2",
    "descriptor_stats": """WITH s AS (SELECT user_id % 7 AS area, user_id // 7 AS slot, count(*) AS n, max(CASE WHEN value < 50 THEN 1 ELSE 2 END) AS kind FROM events GROUP BY 1, 2)
SELECT area, CAST(slot // 4 AS INT) AS byte_no, CAST(bit_or(kind << CAST(slot % 4 * 2 AS INT)) AS INT) AS kinds, CAST(sum(n) AS BIGINT) AS n, max(n) AS levels FROM s GROUP BY 1, 2""",
    "prefix_offsets": "SELECT doc_id, strlen(text) AS bytes, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents",
    "sector_alloc": """WITH s AS (SELECT doc_id, (strlen(text) + 5 + 4095) // 4096 AS sectors FROM documents)
SELECT doc_id, sectors, CAST(coalesce(sum(sectors) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS BIGINT) AS sector FROM s""",
    "cell_index": f"WITH {C} SELECT vec_id, pos, {XYZ}, pos AS pos_back, vec_id % 1024 // 32 * 16 AS x0, pos % 24 * 16 AS y0, vec_id % 1024 % 32 * 16 AS z0 FROM c",
    "neighbors": f"WITH {C}, {_near_sql()} SELECT vec_id, pos, atom, {', '.join(f'v{i} AS {n}' for i, n in enumerate(g.NEAR))} FROM nb",
    "primary_vote": _vote_sql(1),
    "primary_vote_members": _vote_sql(5),
    "cell_read": f"WITH {C} SELECT vec_id, CAST(vec_id % 64 AS INT) AS pos, CASE WHEN {SPARSE} THEN atom ELSE 0 END AS atom FROM c WHERE pos = vec_id % 64 AND vec_id IN (SELECT vec_id FROM c WHERE {SPARSE})",
    "cell_write": f"WITH {C} SELECT vec_id, pos, CASE WHEN pos = vec_id % 64 THEN 99 ELSE atom END AS atom FROM c",
    "constant_grid": f"SELECT vec_id, CAST(pos AS INT) AS pos, CAST(vec_id % 9 AS INT) AS atom FROM embeddings, range({CELLS}) AS r(pos)",
    "region_cells": f"WITH {C}, o AS (SELECT *, {XYZ}, vec_id % 1024 AS slot FROM c) SELECT vec_id, pos, CAST((vec_id // 1024 * 4 + y) * 128 * 128 + (slot % 32 * 4 + z) * 128 + slot // 32 * 4 + x AS BIGINT) AS place FROM o",
    "substitute": f"WITH {C} SELECT vec_id, pos, CAST(CASE WHEN atom % 3 = 0 AND atom BETWEEN 0 AND 31 THEN atom * 5 + 1 ELSE atom END AS INT) AS atom FROM c",
    "classify_absent": f"WITH {C.replace('* 16', '* 2')}, u AS (SELECT vec_id, list_sort(list(DISTINCT atom)) AS entries FROM c WHERE pos < 3 AND atom = 1 + vec_id % 3 GROUP BY 1) SELECT vec_id, CASE WHEN entries IS NULL THEN 'absent' WHEN len(entries) = 1 THEN 'uniform' ELSE 'palette' END AS kind, coalesce(entries, []) AS entries, CASE WHEN len(entries) > 1 THEN CAST(ceil(log2(len(entries))) AS INT) ELSE 0 END AS depth FROM embeddings LEFT JOIN u USING (vec_id)",
    "rank_grid": f"""WITH {C}, s AS (SELECT * FROM c WHERE {SPARSE}), t AS (SELECT vec_id, pos, CASE WHEN {SPARSE} THEN atom ELSE 0 END AS atom FROM c WHERE vec_id IN (SELECT vec_id FROM s)),
n AS (SELECT atom, count(*) AS n FROM t GROUP BY 1), r AS (SELECT atom, CAST(row_number() OVER (ORDER BY n DESC, atom) - 1 AS INT) AS rank FROM n) SELECT vec_id, pos, rank FROM t JOIN r USING (atom)""",
    "fill_grid": f"WITH {C} SELECT vec_id, pos, CASE WHEN atom % 3 <> 0 THEN atom ELSE 0 END AS atom FROM c",
    "voxel_count": "SELECT label, count(*) * 64 AS voxels FROM embeddings GROUP BY 1",
}

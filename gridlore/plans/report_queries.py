"""Scalar, lookup, metric and discovery queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.entropy import byte_table
from ..operators import reports
from ..operators.ordering import sample_evenly
from ..streaming import progress
from .history_queries import table


def _located(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", (F.col("event_id") % 3).cast("int").alias("dim"), (F.col("user_id") % 2000 - 1000).cast("int").alias("rx"), (F.col("event_id") % 4001 - 2000).cast("int").alias("rz"))


LOC = "l AS (SELECT event_id, CAST(event_id % 3 AS INT) AS dim, CAST(user_id % 2000 - 1000 AS INT) AS rx, CAST(event_id % 4001 - 2000 AS INT) AS rz FROM events)"
RID = "(CAST(dim AS BIGINT) << 42) | ((CAST(rx AS BIGINT) & 2097151) << 21) | (CAST(rz AS BIGINT) & 2097151) AS region_id"


def _region_ids(s: SparkSession, d: str) -> DataFrame:
    return _located(s, d).withColumn("region_id", sc.region_id(F.col("dim"), F.col("rx"), F.col("rz")))


def _names(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id")
    k = F.col("event_id") % 5
    tail = F.when(k == 0, ".7.region").when(k == 1, ".-3.txt").when(k == 2, ".x.region").when(k == 3, ".region").otherwise(".1.9.region")
    return e.select("event_id", F.concat(F.lit("r."), (F.col("user_id") - 500).cast("string"), tail).alias("name")).select("event_id", "name", *sc.parse_file_name(F.col("name"), "region"))


def _registry(s: SparkSession, d: str) -> DataFrame:
    """Names of a small dimension table whose size is that of nations; every third name is missing."""
    names = table(s, d, "nation").where("n_nationkey % 3 <> 0").select("n_nationkey", "n_name")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    joined = c.join(names, c.c_nationkey == names.n_nationkey, "left")
    protocol = F.when(F.col("c_custkey") % 3 == 0, 765).when(F.col("c_custkey") % 3 == 1, 769).otherwise(1)
    version = F.lit(0)
    for p, v in sc.DATA_VERSIONS.items():
        version = F.when(protocol == p, v).otherwise(version)
    return joined.select("c_custkey", sc.namespaced(F.coalesce("n_name", F.lit(":unknown"))).alias("name"), version.alias("data_version"), protocol.isin(*sc.DATA_VERSIONS).alias("supported"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    full = F.concat(F.translate(F.lower("p_name"), " ", "_"), F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("[axis=y,size="), size, F.lit("]"))).when(k == 2, F.lit("[-]")).otherwise(F.concat(F.lit("[a=1,b,a="), size, F.lit("]"))))
    props = sc.block_properties(F.col("full"))
    return p.select("p_partkey", full.alias("full")).select(
        "p_partkey", sc.namespaced(sc.block_base(F.col("full"))).alias("name"), F.try_element_at(props, F.lit("a")).alias("prop_a"),
        F.try_element_at(props, F.lit("axis")).alias("prop_axis"), F.try_element_at(props, F.lit("size")).alias("prop_size"), F.size(props).alias("n_props"),
    )


def _formats(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars") * F.col("doc_id")
    return table(s, d, "documents").select(
        "doc_id", sc.format_bytes(n).alias("bench_bytes"), sc.format_bytes(n, "kB").alias("cli_bytes"), sc.format_rate(n * F.lit(0.99731), "voxel/s").alias("rate"),
        sc.format_count(n).alias("counted"), sc.format_duration(F.col("n_chars") / 7).alias("took"),
    )


def _sizes(s: SparkSession, d: str) -> DataFrame:
    """Sums of orders by priority: before, and after, which is larger where the priority's first digit is odd."""
    cents = F.floor("o_totalprice").cast("long")
    after = F.when(F.substring("o_orderpriority", 1, 1).cast("int") % 2 == 1, cents + F.floor(cents / 7)).otherwise(F.floor(cents / 3))
    return table(s, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"),
        F.sum(cents).alias("in_bytes"), F.sum(after).cast("long").alias("out_bytes"),
    )


def _lines(s: SparkSession, d: str) -> DataFrame:
    before, after = F.col("in_bytes"), F.col("out_bytes")
    return _sizes(s, d).select(
        "o_orderpriority", reports.ratio_line("Ratio", before, after).alias("bench"), reports.ratio_line("Ratio", before, after, "kB", 7, "n/a").alias("cli"),
        reports.ratio_line("Ratio", before - before, after, nothing="n/a").alias("nothing"),
        reports.phase_line("read:", before, after, F.lit(2_500_000_000)).alias("read"), reports.phase_line("write:", before, after, F.lit(0)).alias("write"),
    )


def _pace(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("done"), F.count("*").alias("total"))
    return o.select("o_custkey", progress.eta(F.col("total") * 1.5, F.col("done"), F.col("total")).cast("double").alias("eta"))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Documents as files: those of one language can't be decoded."""
    bad = F.col("lang") == "fr"
    return table(s, d, "documents").select(F.col("n_chars").alias("length"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.when(bad, "no content").alias("error"))


def _summary(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    cents = F.floor(F.col("o_totalprice")).cast("long")
    sums = o.select("o_orderpriority", "o_orderstatus", cents.alias("before"), F.floor(cents / 2).cast("long").alias("after")).groupBy("o_orderpriority").agg(
        F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"),
        F.sum("before").alias("before_bytes"), F.sum("after").alias("after_bytes"),
    )
    return sums.withColumn("ratio", F.try_divide((F.col("after_bytes") - F.col("before_bytes")).cast("double"), F.col("before_bytes").cast("double")))


# The largest entry bears the whole correction here; the table of a nearly flat histogram would need more steps.
FREQ = """p AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), c AS (SELECT b, count(*) AS n FROM p GROUP BY 1),
g AS (SELECT CAST(('0x' || b) AS INT) AS byte, n, CAST(greatest(n * 4096 // (SELECT sum(n) FROM c), 1) AS INT) AS freq FROM c),
f AS (SELECT byte, n, CAST(freq + CASE WHEN byte = (SELECT byte FROM g ORDER BY n DESC, byte DESC LIMIT 1) THEN 4096 - (SELECT sum(freq) FROM g) ELSE 0 END AS INT) AS freq FROM g)"""


def _bytes_sql(n: str, k: str) -> str:
    return f"CASE WHEN {n} >= 1073741824 THEN printf('%.2f GB', {n} / 1073741824.0) WHEN {n} >= 1048576 THEN printf('%.2f MB', {n} / 1048576.0) WHEN {n} >= 1024 THEN printf('%.2f {k}', {n} / 1024.0) ELSE printf('%d B', {n}) END"


QUERIES = {
    "region_id": lambda s, d: _region_ids(s, d).select("event_id", "region_id"),
    "region_id_decode": lambda s, d: _region_ids(s, d).select("event_id", *sc.region_fields(F.col("region_id"))),
    "sector_dir": lambda s, d: _located(s, d).select("event_id", sc.region_path(F.when(F.col("dim") == 0, "overworld").when(F.col("dim") == 1, "nether").otherwise("end"), F.col("rx"), F.col("rz"), "region").alias("path"), sc.region_folder(F.col("dim")).alias("folder")),
    "pos_pack": lambda s, d: table(s, d, "events").select("event_id", sc.pack_position(F.col("event_id") % 16, F.col("user_id") % 384, F.col("event_id") % 13).alias("packed")).select("event_id", "packed", *sc.unpack_position(F.col("packed"))),
    "filename_parse": _names,
    "registry_lookup": _registry,
    "block_state_parse": _blocks,
    "format_values": _formats,
    "run_summary": _summary,
    "sample_evenly": lambda s, d: sample_evenly(table(s, d, "documents").select("doc_id", "lang"), "doc_id", 128),
    "pending_outputs": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name"),
    "ratio_line": _lines,
    "run_report": lambda s, d: reports.run_report(_sizes(s, d), F.lit(12.5)).drop("out_bytes"),
    "eta": _pace,
    "enum_names": lambda s, d: table(s, d, "events").select("event_id", sc.named(F.col("event_id") % 10, sc.VERSIONS).alias("version"), sc.named(F.col("event_id") % 4, sc.STATES).alias("state"), sc.named(F.col("event_id") % 5, sc.DIMENSIONS).alias("dimension")),
    "first_failures": lambda s, d: reports.first_failures(_outcomes(s, d), F.col("error").isNull(), "path", ["error"]),
    "first_decodable": lambda s, d: reports.first_decodable(_outcomes(s, d)),
    "byte_freq": lambda s, d: byte_table(table(s, d, "documents"), "text").select("byte", "n", "freq"),
    "prefix_starts": lambda s, d: byte_table(table(s, d, "documents"), "text").select("byte", "freq", "start"),
    "smallest_files": lambda s, d: table(s, d, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(10),
    "dimension_parse": lambda s, d: _located(s, d).select("event_id", sc.parse_dimension(F.when(F.col("dim") == 0, "minecraft:overworld").when(F.col("dim") == 1, "the_nether").otherwise("void")).alias("code")),
}

SQL = {
    "region_id": f"WITH {LOC} SELECT event_id, {RID} FROM l",
    "region_id_decode": f"WITH {LOC} SELECT event_id, dim, rx, rz FROM l",
    "sector_dir": f"""WITH {LOC} SELECT event_id, CASE dim WHEN 0 THEN 'overworld' WHEN 1 THEN 'nether' ELSE 'end' END || '/' || CAST(CAST(floor(rx / 32) AS INT) AS VARCHAR) || '/' || CAST(CAST(floor(rz / 32) AS INT) AS VARCHAR)
 || '/r.' || rx || '.' || rz || '.region' AS path, CASE dim WHEN 1 THEN 'DIM-1/region' WHEN 2 THEN 'DIM1/region' ELSE 'region' END AS folder FROM l""",
    "pos_pack": "SELECT event_id, ((user_id % 384) << 16) | ((event_id % 13) << 8) | (event_id % 16) AS packed, CAST(event_id % 16 AS INT) AS x, CAST(user_id % 384 AS INT) AS y, CAST(event_id % 13 AS INT) AS z FROM events",
    "filename_parse": """WITH n AS (SELECT event_id, user_id, event_id % 5 AS k FROM events)
SELECT event_id, 'r.' || (user_id - 500) || CASE k WHEN 0 THEN '.7.region' WHEN 1 THEN '.-3.txt' WHEN 2 THEN '.x.region' WHEN 3 THEN '.region' ELSE '.1.9.region' END AS name,
 CASE WHEN k IN (0, 4) THEN user_id - 500 END AS rx, CASE k WHEN 0 THEN 7 WHEN 4 THEN 1 END AS rz FROM n""",
    "registry_lookup": """SELECT c_custkey, CASE WHEN n_name IS NULL THEN ':unknown' ELSE 'minecraft:' || n_name END AS name,
 CASE c_custkey % 3 WHEN 0 THEN 3700 WHEN 1 THEN 4189 ELSE 0 END AS data_version, c_custkey % 3 < 2 AS supported
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey""",
    "block_state_parse": """SELECT p_partkey, 'minecraft:' || replace(lower(p_name), ' ', '_') AS name, CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS VARCHAR) END AS prop_a,
 CASE WHEN p_partkey % 4 = 1 THEN 'y' END AS prop_axis, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS VARCHAR) END AS prop_size, CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_props FROM part""",
    "format_values": f"""SELECT doc_id, {_bytes_sql('(n_chars * doc_id)', 'KB')} AS bench_bytes, {_bytes_sql('(n_chars * doc_id)', 'kB')} AS cli_bytes,
 CASE WHEN n_chars * doc_id * 0.99731::DOUBLE >= 1e9 THEN printf('%.2f Gvoxel/s', n_chars * doc_id * 0.99731::DOUBLE / 1e9) WHEN n_chars * doc_id * 0.99731::DOUBLE >= 1e6 THEN printf('%.2f Mvoxel/s', n_chars * doc_id * 0.99731::DOUBLE / 1e6)
 WHEN n_chars * doc_id * 0.99731::DOUBLE >= 1e3 THEN printf('%.2f Kvoxel/s', n_chars * doc_id * 0.99731::DOUBLE / 1e3) ELSE printf('%.2f voxel/s', n_chars * doc_id * 0.99731::DOUBLE) END AS rate,
 format('{{:,}}', n_chars * doc_id) AS counted,
 CASE WHEN n_chars / 7 >= 60 THEN printf('%02dm %02ds', n_chars // 7 // 60, n_chars // 7 % 60) ELSE printf('%.2fs', n_chars / 7) END AS took FROM documents""",
    "run_summary": """WITH o AS (SELECT o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(floor(o_totalprice) AS BIGINT) // 2 AS a FROM orders)
SELECT o_orderpriority, count(*) AS files, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(sum(b) AS BIGINT) AS before_bytes, CAST(sum(a) AS BIGINT) AS after_bytes,
 CAST(sum(a) - sum(b) AS DOUBLE) / CAST(sum(b) AS DOUBLE) AS ratio FROM o GROUP BY 1""",
    "sample_evenly": """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM r WHERE total <= 128 OR idx IN (SELECT i * (SELECT count(*) FROM documents) // 128 FROM range(128) AS g(i))""",
    "pending_outputs": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "ratio_line": f"""WITH o AS (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders), t AS (SELECT o_orderpriority, CAST(sum(c) AS BIGINT) AS b, CAST(sum(CASE WHEN CAST(o_orderpriority[1] AS INT) % 2 = 1 THEN c + c // 7 ELSE c // 3 END) AS BIGINT) AS a FROM o GROUP BY 1),
l AS (SELECT *, CASE WHEN a >= b THEN '+' ELSE '-' END AS s, abs(a - b) AS d, printf('%.1f', abs(CAST(a - b AS DOUBLE) / b * 100)) AS p FROM t)
SELECT o_orderpriority, 'Ratio     : ' || s || {_bytes_sql('d', 'KB')} || ' (' || s || p || '%)' AS bench, 'Ratio  : ' || s || {_bytes_sql('d', 'kB')} || ' (' || s || p || '%)' AS cli, 'n/a' AS nothing,
 'read: ' || printf('%5.1f MB/s | ', b / 2.5::DOUBLE / 1e6) || CASE WHEN a / 2.5 >= 1e9 THEN printf('%.2f Gvoxel', a / 2.5::DOUBLE / 1e9) WHEN a / 2.5 >= 1e6 THEN printf('%.2f Mvoxel', a / 2.5::DOUBLE / 1e6) WHEN a / 2.5 >= 1e3 THEN printf('%.2f Kvoxel', a / 2.5::DOUBLE / 1e3) ELSE printf('%.2f voxel', a / 2.5::DOUBLE) END || ' (2500 ms aggregate)' AS read,
 'write: n/a  (0 ms aggregate)' AS write FROM l""",
    "run_report": """WITH t AS (SELECT o_orderpriority, count(*) AS files, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped, CAST(sum(floor(o_totalprice)) AS BIGINT) AS in_bytes FROM orders GROUP BY 1)
SELECT *, files - failed - skipped AS ok, in_bytes / 1e6::DOUBLE / 12.5::DOUBLE AS mb_s, CASE WHEN failed > 0 THEN 1 ELSE 0 END AS status FROM t""",
    "eta": "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 0 ELSE CAST(count(*) * 1.5 AS DOUBLE) / count(*) FILTER (o_orderstatus = 'O') * count(*) FILTER (o_orderstatus <> 'O') END AS eta FROM orders GROUP BY 1",
    "enum_names": "SELECT event_id, ['0.0.0.1', '0.1.0.0', '0.1.1.0', '0.1.2.0', '0.1.3.0', '0.1.4.0', '1.0.0.0', '1.0.0.1'][event_id % 10] AS version, ['unknown', 'new', 'old'][event_id % 4 + 1] AS state, ['overworld', 'nether', 'end'][event_id % 5 + 1] AS dimension FROM events",
    "first_failures": "SELECT 'd/' || doc_id AS path, 'no content' AS error FROM documents WHERE lang = 'fr' ORDER BY 1 LIMIT 10",
    "first_decodable": "SELECT n_chars AS length, 'd/' || doc_id AS path FROM documents WHERE lang IS DISTINCT FROM 'fr' ORDER BY 1, 2 LIMIT 1",
    "byte_freq": f"WITH {FREQ} SELECT byte, n, freq FROM f",
    "prefix_starts": f"WITH {FREQ} SELECT byte, freq, CAST(coalesce(sum(freq) OVER (ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f",
    "smallest_files": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10",
    "dimension_parse": f"WITH {LOC} SELECT event_id, CASE dim WHEN 0 THEN 0 WHEN 1 THEN 1 END AS code FROM l",
}

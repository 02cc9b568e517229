"""Queries that write, convert and read region files, and code texts with the entropy coders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import entropy
from ..functions.regions import CELLS, SECTIONS, SLOTS, UNCHANGED, Layout
from ..operators.grid import sections_of
from ..operators.temporal import micros
from ..sources import region_files as rf
from ..sources.file_sink import save_files, scratch_folder
from .grid_queries import C, cells
from .history_queries import table

ROWS, COLUMNAR = Layout(b"rowgrid"), Layout(b"colgrid", columnar=True)
PER_REGION = SLOTS * SECTIONS[0]


def _files(s: SparkSession, d: str) -> DataFrame:
    """Row-layout files of all embeddings, each a biome section of some slot; a region holds PER_REGION of them."""
    atoms = cells(s, d).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom"))), lambda c: c["atom"]).alias("atoms"))
    whole = lambda c: c.cast("int")
    places = atoms.select(
        (F.col("vec_id") / PER_REGION).cast("long").cast("string").alias("path"), F.lit(0).alias("dim"), F.lit(769).alias("protocol"), F.lit(8).alias("version"),
        whole(F.col("vec_id") % SLOTS).alias("slot"), F.lit("biome").alias("domain"), whole(F.col("vec_id") % PER_REGION / SLOTS).alias("section"),
        F.lit(0).alias("level"), F.col("vec_id").alias("ts"), "atoms",
    )
    return rf.write_region_files(rf.pack_cells(places), ROWS)


def _read(files: DataFrame, layout: Layout) -> DataFrame:
    found = rf.snapshot_atoms(rf.read_region_files(files, layout))
    return found.select(F.col("ts").alias("vec_id"), F.posexplode("atoms").alias("pos", "atom"))


MODELLED = Layout(b"colgrid", columnar=True, modelled=True)
#: Vectors of 64 cells in a block section, sections that a test region takes, regions of events.
PER_SECTION, TAKEN, AREAS = CELLS["block"] // 64, 16, 7


def _head(path: Column, record: str, slot: Column, **fields: Column) -> list[Column]:
    kinds = dict(f.split() for f in rf.FIELDS.split(", "))
    given = {"dim": F.lit(1), "protocol": F.lit(769), "version": F.lit(8), "record": F.lit(record), "slot": slot, **fields}
    return [path.cast("string").alias("path"), *(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items())]


def _block_records(s: SparkSession, d: str) -> DataFrame:
    """Block sections of 64 vectors each with two levels: the newest cells, and below it every fifth one's other value."""
    whole = F.floor(F.col("vec_id") / PER_SECTION)
    placed = cells(s, d, 4).select(whole.cast("long").alias("at"), (F.col("vec_id") % PER_SECTION * 64 + F.col("pos")).alias("pos"), "atom")
    newest = sections_of(placed, "at", CELLS["block"])
    older = F.transform("atoms", lambda a, i: F.when(i % 5 == 0, a + 1).otherwise(UNCHANGED))
    levels = newest.select("at", F.posexplode(F.array("atoms", older)).alias("level", "atoms"))
    return rf.pack_cells(
        levels.select(
            F.floor(F.col("at") / TAKEN).cast("string").alias("path"), F.lit(1).alias("dim"), F.lit(769).alias("protocol"), F.lit(8).alias("version"),
            (F.col("at") % TAKEN * 33 % SLOTS).cast("int").alias("slot"), F.lit("block").alias("domain"), (F.col("at") % TAKEN).cast("int").alias("section"),
            "level", (F.col("at") * 10 - F.col("level")).alias("ts"), "atoms",
        )
    )


def _event_records(s: SparkSession, d: str) -> DataFrame:
    """State logs and tile feeds of events: regions by user, slots by user, one state and one tile an event, newest first."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("ts"))
    area, slot = F.col("user_id") % AREAS, (F.col("user_id") % SLOTS).cast("int")
    level = (F.row_number().over(Window.partitionBy("area", "slot").orderBy(F.desc("ts"), F.desc("event_id"))) - 1).cast("int")
    e = e.withColumn("area", area).withColumn("slot", slot).withColumn("level", level).withColumn("area", F.concat(F.lit("e"), F.col("area").cast("string")))
    at = {"level": F.col("level"), "ts": F.col("ts")}
    put = F.col("value") >= 50
    tile = {"pos": F.col("event_id") % 65536, "tile_type": F.when(put, F.col("event_id") % 9), "nbt": F.when(put, F.encode("event_type", "utf-8"))}
    states = e.select(_head(F.col("area"), "state", F.col("slot"), state=F.col("event_id") % 3, **at))
    heads = e.select(_head(F.col("area"), "tiles", F.col("slot"), **at))
    return states.unionByName(heads).unionByName(e.select(_head(F.col("area"), "tile", F.col("slot"), **at, **tile)))


def _reread(records: DataFrame, layout: Layout) -> DataFrame:
    """The records of files that have been written to the shared folder and are read from there."""
    spark = records.sparkSession
    folder = scratch_folder(spark, "region-files")
    made = rf.write_region_files(records, layout)
    outcomes = save_files(made.withColumn("target", F.concat("path", F.lit(".region"))), folder, "target")
    if outcomes.where("outcome <> 'written'").count():
        raise ValueError("a region file could not be written")
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]*)\.region$", 1)
    return rf.read_region_files(files.select(name.alias("path"), "content"), layout)


def _blocks(layout: Layout):
    def query(s: SparkSession, d: str) -> DataFrame:
        found = rf.snapshot_atoms(_reread(_block_records(s, d), layout))
        total = F.aggregate(F.transform("atoms", lambda a, i: a.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda x, y: x + y)
        return found.select("path", "slot", "section", "level", "ts", total.alias("total"), F.array_max("atoms").alias("most"))

    return query


def _events(layout: Layout, record: str, *columns: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        found = _reread(_event_records(s, d), layout).where(F.col("record") == record).withColumn("nbt", F.decode("nbt", "utf-8"))
        return found.select("path", "slot", "level", "ts", *columns)

    return query


def _streams(s: SparkSession, d: str) -> DataFrame:
    files = rf.write_region_files(_event_records(s, d), ROWS)
    return rf.stream_table(files, ROWS).where("stream IN ('chunk_info', 'model', 'tile_entities', 'buckets')").select("stream", "files", "bytes")


def _trips(table_name: str, key: str, coder: str):
    return lambda s, d: entropy.round_trips(table(s, d, table_name), key, "text", coder).select(key, "bytes", "restored")


def _trips_sql(table_name: str, key: str) -> str:
    return f"SELECT {key}, strlen(text) AS bytes, CASE WHEN text IS NOT NULL THEN true END AS restored FROM {table_name}"


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    done = rf.convert(_files(s, d), ROWS, COLUMNAR)
    return done.agg(F.count("*").alias("files"), F.count_if("same").alias("same"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("voxels").alias("voxels"))


QUERIES = {
    "region_rows": lambda s, d: _read(_files(s, d), ROWS),
    "region_migrate": lambda s, d: _read(rf.convert(_files(s, d), ROWS, COLUMNAR), COLUMNAR),
    "region_outcomes": _outcomes,
    "file_blocks": _blocks(ROWS),
    "file_blocks_columnar": _blocks(COLUMNAR),
    "model_roundtrip": _blocks(MODELLED),
    "file_states": _events(ROWS, "state", "state"),
    "file_states_columnar": _events(COLUMNAR, "state", "state"),
    "file_tiles": _events(ROWS, "tile", "pos", "tile_type", "nbt"),
    "file_tiles_columnar": _events(COLUMNAR, "tile", "pos", "tile_type", "nbt"),
    "stream_sizes": _streams,
    "rans_roundtrip": _trips("documents", "doc_id", "static"),
    "range_roundtrip": _trips("benchmark", "item_id", "adaptive"),
    "range_roundtrip_documents": _trips("documents", "doc_id", "adaptive"),
    "zstd_roundtrip": _trips("documents", "doc_id", "zstd"),
}

_CELLS = f"WITH {C} SELECT vec_id, CAST(pos AS INT) AS pos, atom FROM c"
_BLOCKS = f"""WITH {C.replace('* 16', '* 4')}, n AS (SELECT vec_id // 64 AS sec, vec_id % 64 * 64 + pos AS pos, atom FROM c),
f AS (SELECT a.sec, p.pos, coalesce(n.atom, 0) AS atom FROM (SELECT DISTINCT sec FROM n) a CROSS JOIN range(4096) AS p(pos) LEFT JOIN n ON n.sec = a.sec AND n.pos = p.pos),
l AS (SELECT sec, pos, 0 AS level, atom FROM f UNION ALL SELECT sec, pos, 1, CASE WHEN pos % 5 = 0 THEN atom + 1 ELSE 65535 END FROM f)
SELECT CAST(sec // 16 AS VARCHAR) AS path, CAST(sec % 16 * 33 AS INT) AS slot, CAST(sec % 16 AS INT) AS section, level, sec * 10 - level AS ts, CAST(sum(atom * (pos + 1)) AS BIGINT) AS total, CAST(max(atom) AS BIGINT) AS most FROM l GROUP BY sec, level"""
_EVENTS = """WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS ts, user_id % 7 AS area, CAST(user_id % 1024 AS INT) AS slot FROM events),
f AS (SELECT *, 'e' || area AS path, CAST(row_number() OVER (PARTITION BY area, slot ORDER BY ts DESC, event_id DESC) - 1 AS INT) AS level FROM e)"""
_STATES = f"{_EVENTS} SELECT path, slot, level, ts, CAST(event_id % 3 AS INT) AS state FROM f"
_TILES = f"{_EVENTS} SELECT path, slot, level, ts, event_id % 65536 AS pos, CASE WHEN value >= 50 THEN event_id % 9 END AS tile_type, CASE WHEN value >= 50 THEN event_type END AS nbt FROM f"

SQL = {
    "region_rows": _CELLS,
    "region_migrate": _CELLS,
    "region_outcomes": f"""WITH r AS (SELECT vec_id // {PER_REGION} AS region, count(DISTINCT vec_id % {SLOTS}) AS slots FROM embeddings GROUP BY 1)
SELECT count(*) AS files, count(*) AS same, CAST(0 AS BIGINT) AS failed, CAST(sum(slots) * {SECTIONS[0] * 4096} AS BIGINT) AS voxels FROM r""",
    "file_blocks": _BLOCKS,
    "file_blocks_columnar": _BLOCKS,
    "model_roundtrip": _BLOCKS,
    "file_states": _STATES,
    "file_states_columnar": _STATES,
    "file_tiles": _TILES,
    "file_tiles_columnar": _TILES,
    # A state takes 9 bytes after a count of 2 a slot; a feed of one tile 17 bytes and 8 and its payload if it is put, after a count of 4 a slot.
    "stream_sizes": f"""{_EVENTS}, n AS (SELECT count(DISTINCT path) AS files, count(DISTINCT (path, slot)) AS slots, count(*) AS n, sum(CASE WHEN value >= 50 THEN 8 + strlen(event_type) ELSE 0 END) AS puts FROM f)
SELECT 'chunk_info' AS stream, files, CAST(2 * slots + 9 * n AS BIGINT) AS bytes FROM n UNION ALL SELECT 'tile_entities', files, CAST(4 * slots + 17 * n + puts AS BIGINT) FROM n
UNION ALL SELECT 'model', files, CAST(4 * files AS BIGINT) FROM n UNION ALL SELECT 'buckets', files, CAST(0 AS BIGINT) FROM n""",
    "rans_roundtrip": _trips_sql("documents", "doc_id"),
    "range_roundtrip": _trips_sql("benchmark", "item_id"),
    "range_roundtrip_documents": _trips_sql("documents", "doc_id"),
    "zstd_roundtrip": _trips_sql("documents", "doc_id"),
}

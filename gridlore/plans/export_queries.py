"""Queries that write registries, region files and chunk containers to the shared folder and read them back, each with its SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anvil, nbt
from ..functions.regions import SECTIONS, SLOTS
from ..operators import dictionary as di
from ..sources import chunk_export, registry_json
from ..sources import region_files as rf
from ..sources.file_sink import save_files, scratch_folder
from ..sources.region_source import RegionSource
from .grid_queries import PAL, cells
from .history_queries import table
from .region_queries import _STATES, ROWS, _event_records, _head

#: Moment of the export, between the two snapshots of every section.
AT, PROTOCOL, DIM = 150, 769, 1


def _registries(s: SparkSession, d: str) -> str:
    """A protocol's three registry files of regions and nations (25 rows); every fifth nation is missing."""
    nations = table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    known = [(r.n_nationkey, r.n_name.lower().replace(" ", "_")) for r in nations if r.n_nationkey % 5]
    listed = {
        "block": [{"id": i, "name": f"{n}[key={i},odd={'true' if i % 2 else 'false'}]" if i % 3 else n} for i, n in known] + [{"id": 1 << 16, "name": "too_large"}],
        "biome": [{"id": i, "name": f"mod:{n}"} for i, n in known], "tile": [{"id": i, "name": n} for i, n in known],
    }
    folder = scratch_folder(s, "registries")
    rows = [(f"{PROTOCOL}/{registry_json.FILES[kind]}", bytearray(json.dumps({"entries": e}).encode())) for kind, e in listed.items()]
    written = save_files(s.createDataFrame(rows, "path string, content binary"), folder).collect()
    if any(r.outcome != "written" for r in written):
        raise ValueError("a registry could not be written")
    return folder


def _registry(s: SparkSession, d: str) -> DataFrame:
    root = _registries(s, d)
    found = None
    for kind in registry_json.FILES:
        part = registry_json.registry(s, root, PROTOCOL, kind).withColumn("kind", F.lit(kind))
        if kind == "block":
            part = part.withColumn("key", F.try_element_at("properties", F.lit("key"))).drop("properties")
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found.select("kind", "id", "name", "key")


def _customers(s: SparkSession, d: str) -> DataFrame:
    """Regions by customer number, a segment for each customer; its sections change from one nation's block to the next at 200."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    path = F.concat(F.lit("r."), F.floor(F.col("c_custkey") / SLOTS).cast("string"), F.lit(".-1.region"))
    slot = F.col("c_custkey") % SLOTS
    every = c.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS[DIM] - 1)))).withColumn("domain", F.explode(F.array(F.lit("block"), F.lit("biome"))))
    every = every.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))).where("c_custkey % 10 <> 9 OR section > 0")  # such segments lack a section
    older = F.when(F.col("domain") == "block", F.col("c_nationkey")).otherwise(F.col("section"))
    value = F.when(F.col("level") == 0, older + 1).otherwise(older)
    at = {"level": F.col("level"), "ts": F.lit(200) - F.col("level") * 100}
    snapshots = every.select(_head(path, "snapshot", slot, domain=F.col("domain"), section=F.col("section"), single=value, **at))
    put = {"pos": F.col("c_custkey") % 16 * 65537, "tile_type": F.col("c_nationkey"), "nbt": F.lit(nbt.write_payload(nbt.Tag("compound", {})))}
    first = {"level": F.lit(0), "ts": F.lit(140)}
    heads = c.select(_head(path, "tiles", slot, **first))
    return snapshots.unionByName(heads).unionByName(c.select(_head(path, "tile", slot, **first, **put)))


def _exported(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Outcomes, and the folder that holds the chunk containers."""
    names = {PROTOCOL: chunk_export.load_names(s, _registries(s, d), PROTOCOL)}
    folder = scratch_folder(s, "export")
    files = rf.write_region_files(_customers(s, d), ROWS)
    made = chunk_export.export_files(files, ROWS, DIM, "region", "mca", AT, names, root=folder)
    made.write.parquet(f"{folder}-outcomes")
    return s.read.schema(made.schema).parquet(f"{folder}-outcomes"), folder


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """What the containers hold: a row for each chunk."""
    _, folder = _exported(s, d)
    files = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mca").load(folder).select("content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for (lx, lz), (ts, raw) in anvil.read_region(bytes(content)).items():
                    root = nbt.read_root(raw).value
                    block = root["sections"].value[1][3].value["block_states"].value["palette"].value[1][0].value
                    biome = root["sections"].value[1][3].value["biomes"].value["palette"].value[1][0].value
                    tile = root["block_entities"].value[1][0].value
                    key = block["Properties"].value["key"].value if "Properties" in block else None
                    rows.append((lx, lz, ts, root["DataVersion"].value, root["xPos"].value, root["zPos"].value, block["Name"].value, key, biome, tile["id"].value, tile["x"].value, tile["y"].value))
                yield pd.DataFrame(rows, columns=["lx", "lz", "ts", "version", "x", "z", "block", "block_key", "biome", "tile", "tile_x", "tile_y"])

    return files.mapInPandas(run, "lx int, lz int, ts long, version int, x int, z int, block string, block_key string, biome string, tile string, tile_x int, tile_y int")


def _summary(s: SparkSession, d: str) -> DataFrame:
    outcomes, folder = _exported(s, d)
    return chunk_export.export_summary(outcomes).select("files", "written", "made", "skipped", "failed")


def _source(s: SparkSession, d: str) -> DataFrame:
    """The registered data source writes and reads the files."""
    s.dataSource.register(RegionSource)
    options = {"path": scratch_folder(s, "region-source"), "suffix": "region", "signature": "rowgrid"}
    records = _event_records(s, d).withColumn("path", F.concat("path", F.lit(".region"))).repartition("path")
    records.write.format("region").options(**options).mode("append").save()
    found = s.read.format("region").options(**options).load().where("record = 'state'")
    return found.select(F.split_part("path", F.lit("."), F.lit(1)).alias("path"), "slot", "level", "ts", "state")


def _discovered(s: SparkSession, d: str) -> DataFrame:
    """Five of the files of suppliers, evenly spread by path, and what their names say; others have another suffix."""
    folder = scratch_folder(s, "discover")
    suffix = F.when(F.col("s_suppkey") % 2 == 0, ".region").otherwise(".txt")
    name = F.concat(F.lit("r."), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), suffix)
    rows = table(s, d, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/"), name).alias("path"), F.encode("s_name", "utf-8").alias("content"))
    if save_files(rows, folder).where("outcome <> 'written'").count():
        raise ValueError("a file could not be written")
    return registry_json.discover(s, folder, "region", sample=5).select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("path"), "length", "rx", "rz")


QUERIES = {
    "registry_files": _registry,
    "export_chunks": _chunks,
    "export_summary": _summary,
    "data_source": _source,
    "discover_sample": _discovered,
    "atom_palette": lambda s, d: di.palette(cells(s, d), "vec_id", "atom").select("vec_id", "atom", "rk", di.palette_bits(F.when(F.col("size") > 20, 0).otherwise(F.col("size"))).cast("int").alias("bits")),
}

_KNOWN = "k AS (SELECT n_nationkey AS id, replace(lower(n_name), ' ', '_') AS name FROM nation WHERE n_nationkey % 5 <> 0)"
_C = "c AS (SELECT c_custkey, c_nationkey AS n, c_custkey // 1024 AS rx, c_custkey % 1024 AS slot FROM customer WHERE c_custkey % 10 <> 9)"
SQL = {
    "registry_files": f"""WITH {_KNOWN} SELECT 'block' AS kind, CAST(id AS BIGINT) AS id, name, CASE WHEN id % 3 <> 0 THEN CAST(id AS VARCHAR) END AS key FROM k
UNION ALL SELECT 'biome', id, 'mod:' || name, NULL FROM k UNION ALL SELECT 'tile', id, name, NULL FROM k""",
    "export_chunks": f"""WITH {_KNOWN}, {_C}, p AS (SELECT *, slot // 32 AS lx, slot % 32 AS lz, c_custkey % 16 * 65537 AS pos FROM c)
SELECT CAST(lx AS INT) AS lx, CAST(lz AS INT) AS lz, CAST(140 AS BIGINT) AS ts, 4189 AS version, CAST(rx * 32 + lx AS INT) AS x, CAST(-32 + lz AS INT) AS z,
 CASE WHEN b.name IS NULL THEN ':unknown' ELSE 'minecraft:' || b.name END AS block, CASE WHEN b.id % 3 <> 0 THEN CAST(b.id AS VARCHAR) END AS block_key,
 (SELECT 'mod:' || name FROM k WHERE id = 3) AS biome, CASE WHEN b.name IS NULL THEN ':unknown' ELSE 'minecraft:' || b.name END AS tile, CAST(pos & 255 AS INT) AS tile_x, CAST(pos >> 16 AS INT) AS tile_y
FROM p LEFT JOIN k b ON b.id = n""",
    "export_summary": "SELECT count(DISTINCT c_custkey // 1024) AS files, count(DISTINCT c_custkey // 1024) AS written, 0 AS made, 0 AS skipped, 0 AS failed FROM customer",
    "data_source": _STATES,
    "discover_sample": """WITH f AS (SELECT 'd' || s_suppkey % 3 || '/r.' || s_nationkey || '.' || s_suppkey || '.region' AS path, strlen(s_name) AS length, CAST(s_nationkey AS INT) AS rx, CAST(s_suppkey AS INT) AS rz FROM supplier WHERE s_suppkey % 2 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS place, count(*) OVER () AS total FROM f) SELECT path, length, rx, rz FROM r WHERE total <= 5 OR place IN (SELECT i * (SELECT count(*) FROM f) // 5 FROM range(5) AS g(i))""",
    "atom_palette": f"""WITH {PAL}, o AS (SELECT vec_id, atom, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, atom) - 1 AS rk, size, bits FROM pal) SELECT vec_id, atom, CAST(rk AS INT) AS rk, CASE WHEN size > 20 THEN 16 ELSE bits END AS bits FROM o""",
}

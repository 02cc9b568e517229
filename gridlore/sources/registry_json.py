"""Registry files and region-file discovery through Spark's own readers, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import block_base, block_properties, parse_file_name

_ENTRIES = "entries array<struct<id:bigint,name:string>>"
#: File names of the three registries.
FILES = {"block": "blockstates.json", "biome": "biome_properties.json", "tile": "tile_entities.json"}


def registry(spark: SparkSession, root: str, protocol: int, kind: str) -> DataFrame:
    """(protocol, id, name[, base, properties]) of <root>/<protocol>/<file>; ids outside their width go."""
    raw = spark.read.schema(_ENTRIES).option("multiLine", True).json(f"{root}/{protocol}/{FILES[kind]}")
    rows = raw.select(F.explode("entries").alias("e")).select(F.lit(protocol).alias("protocol"), "e.id", "e.name")
    rows = rows.where(F.col("id").between(0, (1 << 32) - 1 if kind == "tile" else (1 << 16) - 1))
    if kind == "block":
        rows = rows.withColumn("properties", block_properties(F.col("name"))).withColumn("name", block_base(F.col("name")))
    return rows


def discover(spark: SparkSession, root: str, suffix: str, sample: int | None = None) -> DataFrame:
    """(path, length, rx, rz) of all files with the suffix below root, by path; content is not read, empty files are not listed.

    sample: so many of them, evenly spread over the order (all, if there are no more).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", "length", *parse_file_name(name, suffix)).orderBy("path")
    if sample is None:
        return found
    # File names only: a list of files is small beside the files, and the engine has listed them on the driver already.
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1)
    total = numbered.count()
    if sample >= total:
        return found
    taken = [i * total // sample for i in range(sample)]
    chosen = spark.createDataFrame([(p,) for p in taken], "place int")
    return numbered.join(F.broadcast(chosen), "place").orderBy("path").drop("place")

"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a broadcast side that an operator accepts after having measured them.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a session in one process (tests) gets a folder of its own; on a cluster, whose
    machines share no local folder, it is one in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = f"file://{tempfile.mkdtemp(prefix='gridlore-')}"
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/gridlore-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that scratch_path() has named and drop_scratch() hasn't deleted.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _WRITTEN.append(f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage through a table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a table made by materialise()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def drop_scratch(spark: SparkSession, after: str | None = None) -> None:
    """Delete the folders that this session's operators have named, or those named after one of them.

    Results of operators may read them, so call this when these have been written.
    """
    first = _WRITTEN.index(after) + 1 if after else 0
    while len(_WRITTEN) > first:
        delete_folder(spark, _WRITTEN.pop())


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most max_rows training rows: not held out, known label, one row an id.

    The bound is the documented parameter that makes the later broadcast safe. Rows are taken in
    the order of a hash of the id, so the choice is the same in every run.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of the texts of a repeated id the one with the smallest hash, then the smallest. Null is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(text), text)).alias("one")).select("doc_id", F.col("one.col2").alias("text"))


def map_texts(
    df: DataFrame, schema: str, rows: Callable[[list, list], dict[str, pa.Array | list]], slice_rows: int = 512
) -> DataFrame:
    """Arrow batches of (doc_id, text) through rows(ids, texts); null texts arrive as ''.

    Batches are cut into slices so that a run of very long texts stays small in Python.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                ids = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                made = rows(ids, texts)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Counts the rows, so the size is measured and not assumed."""
    return df.count() * bytes_per_row <= limit


#: A group is hot if it holds more than one in so many of all rows, so fewer groups than this can be.
HOT_GROUPS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows left-joined with the row of their group; groups: unique non-null keys and a size, the count of their rows.

    Groups of more than 1 in HOT_GROUPS of all rows are fewer than HOT_GROUPS, so they are broadcast however
    large the input is, and their rows stay where they are. The others are shuffled; none of them is larger than
    that share. Both inputs are read more than once and should be tables.
    """
    most = rows.count() // HOT_GROUPS
    hot = F.broadcast(groups.where(F.col(size) > most))
    here = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= most), keys, "left")
    return here.unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches, at most so many rows and about so many characters; a longer text is alone. Null is empty."""
    for batch in batches:
        ids: list = []
        texts: list[str] = []
        held = 0
        for cut in range(0, batch.num_rows, 256):
            part = batch.slice(cut, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and (len(ids) == rows or held + len(text) > size):
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield ids, texts


def text_partitions(docs: DataFrame, most: int, least: int) -> int:
    """Partitions by the texts' bytes: none much over most, and no more than shuffle partitions below least each."""
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    dealt = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // least)
    return max(1, dealt, -(-size // most))


def row_content() -> Column:
    """A row's text as 32 bytes; with doc_id they say which row it is."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the rows that are lost, and with one of the rows that share doc_id and text.

    decided, a table: doc_id, content (row_content), n (the count of such rows), lost; all that are lost or
    more than one. It is broadcast if it is small. Otherwise only entries of more than 1 in HOT_GROUPS of
    all rows are, which are fewer than HOT_GROUPS, and no other is larger than that share. Of rows that differ in
    other columns the one with the smallest hash stays; it is a partial minimum, so rows don't meet.
    """
    decided = decided.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), F.col("n").alias("__n"), "lost")
    keyed = docs.withColumn("__key", row_content())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__content"))
    most = 0 if fits_broadcast(decided, 96) else docs.count() // HOT_GROUPS
    few, many = F.col("__n") > most, F.col("__n") <= most
    rest = keyed.join(F.broadcast(decided.where(few)), same, "left_anti")
    if most:
        rest = rest.join(decided.where(many), same, "left_anti")
    rest = rest.drop("__key")
    repeated = decided.where("NOT lost")
    if repeated.isEmpty():
        return rest
    again = keyed.join(F.broadcast(repeated.where(few)), same, "left_semi")
    if most:
        again = again.unionByName(keyed.join(repeated.where(many), same, "left_semi"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy("doc_id", "__key").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
    return rest.unionByName(one.select("__row.*"))


def docs_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that content operators read, so clashing extra columns can't matter."""
    return docs.select("doc_id", "text")

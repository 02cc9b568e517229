"""Exact dedup: 128-bit content hashes group documents, bytes are compared inside groups.

1. Every row gets the md5 of its normalised text, and a table of rows without texts is written; counting rows
   per hash has partial sums on the map side, so one group with a third of all rows is a few numbers a task.
2. Rows of hashes that occur more than once have their texts compared: the smallest and largest
   normalised text of a hash are the same bytes, or the hash is a collision. Again both are partial
   aggregates, so no group meets in one place as rows.
3. Rows of a colliding hash (normally none) are regrouped by hash and the text itself.
4. The row that stays is a partial maximum of (code points, smallest doc_id; to drop copies, then the text's hash). Rows meet their group's row
   where they are if the group is large, by a shuffle if it is small (common.join_groups).

Defined cases: a null text counts as empty; rows with the same doc_id and text are members of their
group like any other; a null doc_id stays only if the group has no other candidate of that length;
an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, docs_text, drop_materialised, join_groups, keep_rows, materialise, row_content

#: The characters that do not count, \x20 and \x09 to \x0D.
IGNORED = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return (
        docs_text(docs)
        .withColumn("norm", F.translate(text, IGNORED, ""))
        .withColumn("n_points", F.length(text))
        .withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
    )


def colliding_hashes(keyed: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Hashes under which different texts meet. keyed: norm, hash of every row; rows: a table with the same hashes."""
    repeated = (keyed if rows is None else rows).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = materialise(repeated, "repeated-hashes")
    if repeated.count() * 64 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    return (
        keyed.select("hash", "norm")
        .join(repeated, "hash", "left_semi")
        .groupBy("hash")
        .agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        .where("least <> most")
        .select("hash")
    )


def _grouped(docs: DataFrame, carried: Column, order: list[str]) -> DataFrame:
    """Each row's doc_id and carried column; for groups of several rows group_size and best, their row that stays."""
    keyed = _keyed(docs)
    rows = materialise(keyed.select("doc_id", "n_points", "hash", F.lit("").alias("bytes"), carried), "hashed-rows")
    colliding = materialise(colliding_hashes(keyed, rows), "colliding-hashes")
    if not colliding.isEmpty():
        drop_materialised(rows)
        odd = keyed.join(colliding.withColumn("odd", F.lit(True)), "hash", "left")
        rows = odd.select("doc_id", "n_points", "hash", F.when(F.col("odd"), F.col("norm")).otherwise("").alias("bytes"), carried)
        rows = materialise(rows, "hashed-rows")
    # The largest (code points, complement of doc_id, which falls as it rises): a null id orders below every other.
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("minus"), *order))
    groups = rows.groupBy("hash", "bytes").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("hash", "bytes", F.bitwise_not("best.minus").alias("keep_id"), *[F.col(f"best.{c}").alias(f"keep_{c}") for c in order], "group_size")
    shared = materialise(groups.where("group_size > 1"), "shared-groups")
    return join_groups(rows, shared, ["hash", "bytes"], "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row."""
    joined = _grouped(docs, F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), [])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, all columns kept. A repeated (doc_id, text) row stays once.

    Rows are told apart by doc_id and text, null ids too: of a group's rows with the most code points and then
    the smallest doc_id, one stays.
    """
    rows = _grouped(docs, row_content().alias("content"), ["content"]).where("group_size > 1")
    lost = ~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("content") == F.col("keep_content")))
    # doc_id and text have one group, so lost is the same in all rows of both.
    decided = rows.groupBy("doc_id", "content").agg(F.count("*").alias("n"), F.first(lost).alias("lost"))
    return keep_rows(docs, materialise(decided.where("lost OR n > 1"), "decided-rows"))

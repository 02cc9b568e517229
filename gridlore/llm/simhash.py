"""SimHash near-dedup with meet-in-the-middle ball hashing.

Fingerprints: each Arrow slice computes 64-bit fingerprints of whole texts; only (doc_id,
fingerprint) goes on. Equal fingerprints fold into one node, so thousands of copies are one row.

Links: a distinct fingerprint emits itself and its 64 one-bit variants (the ball of half the radius
2). Two fingerprints differ in at most 2 bits exactly when their balls meet. Fingerprints that meet
in a variant are each within one bit of it, so a variant has at most 65 of them and links to the smallest of
them connect all: at most 64 pairs a variant, verified by bit count, never all pairs. Any chance of a
hot variant is excluded by that bound.

Components over distinct fingerprints come from components(); the id is the smallest doc_id.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any
other; a null doc_id is a member, but an id only where no other member has one; repeated rows repeat;
an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import docs_text, join_groups, keep_rows, map_texts, materialise
from .components import components

SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """The text's fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    count = max(1, len(words) - width + 1)
    stop = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    half, ones = count / 2, np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # bounded memory for very long texts
        cut = slice(at, at + (1 << 16))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:count][cut].tolist(), stop[cut].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones > half).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    def rows(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "fp": [fingerprint(t, width) for t in texts]}

    return map_texts(docs_text(docs), "doc_id long, fp long", rows)


def ball_links(nodes: DataFrame) -> DataFrame:
    """(u, v) links that connect all of nodes' distinct fp within 2 bits. nodes: fp, distinct."""
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    balls = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))  # at most 65 rows a variant
    met = balls.select("fp", least.alias("other")).where("other <> fp")
    return met.where("bit_count(fp ^ other) <= 2").select(F.col("other").alias("u"), F.col("fp").alias("v")).distinct()


def _chosen(prints: DataFrame, member: Column) -> DataFrame:
    """(fp, n_docs, chosen): the smallest member of each fingerprint's component. prints: a table with fp."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(member).alias("first"), F.count("*").alias("n_docs")), "nodes")
    roots = components(ball_links(nodes.select("fp"))).withColumnRenamed("u", "fp")
    linked = materialise(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("first").alias("chosen"), F.count("*").alias("n_nodes")), "least")
    return materialise(join_groups(linked, least, ["root"], "n_nodes").select("fp", "n_docs", "chosen"), "named")


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each input row."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    named = _chosen(prints, F.col("doc_id")).withColumnRenamed("chosen", "component_id")
    return join_groups(prints, named, ["fp"], "n_docs").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with one row of each group: that of the smallest id, or one without an id where no row has one.

    Rows are told apart by doc_id and text; rows that share both stay once.
    """

    def rows(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "fp": [fingerprint(t, width) for t in texts], "content": [sha256(t.encode("utf-8")).digest() for t in texts]}

    prints = materialise(map_texts(docs_text(docs), "doc_id long, fp long, content binary", rows), "fingerprints")
    named = _chosen(prints, F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "content"))
    lost = ~(F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("content") == F.col("chosen.content")))
    # A text has one fingerprint and one component, so lost is the same in all rows of doc_id and text.
    decided = join_groups(prints, named, ["fp"], "n_docs").groupBy("doc_id", "content")
    decided = decided.agg(F.count("*").alias("n"), F.first(lost).alias("lost"))
    return keep_rows(docs, materialise(decided.where("lost OR n > 1"), "decided-rows"))

"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and one join, so a hub with very many leaves is partial minima and a
join that the engine may split; nothing is collected and no group is gathered. Rounds grow with the
logarithm of the longest chain. Every round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, materialise


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every u keeps its smallest neighbour, its others are linked to that."""
    least = _least(edges)
    moved = edges.join(least, "u")
    pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every node that has an edge, with the smallest node it reaches. edges: u, v of one type.

    Null ends and loops are ignored; no edges give no rows.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    state = _state(now)
    while state[0]:
        # distinct() only folds repeats, which the stars make many of; the stars themselves don't need it.
        after = materialise(_small_star(_large_star(now)).distinct(), "edges")
        was, state = state, _state(after)
        drop_materialised(now)
        now = after
        if state == was:
            break
    roots = now.select("u", F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())

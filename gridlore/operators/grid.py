"""Dense grid operators on rows (key, pos, atom) with pos = y*s*s + z*s + x.

A tile has a fixed number of cells, so it is a row of bounded size: neighbour operators gather it once by its key and
shift whole arrays. Positions outside the tile are ignored; of repeated positions one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.newest_grid import REACH, VOTES

#: Fixed value: atom of a neighbour outside the grid.
BORDER = 65535
#: Names of the twelve causal neighbours, in their order.
NEAR = (
    "west", "below", "north", "west_north", "west_below", "below_north", "west_below_north", "east_below", "east_below_north",
    "west_2", "north_2", "below_2",
)
#: Cells that a task works on at once.
STEP_CELLS = 1 << 18


def coordinates(pos: Column, s: int) -> tuple[Column, Column, Column]:
    """x, y, z"""
    return (pos % s).cast("int"), F.floor(pos / (s * s)).cast("int"), (F.floor(pos / s) % s).cast("int")


def position(x: Column, y: Column, z: Column, s: int) -> Column:
    return (y * s * s + z * s + x).cast("int")


def tile_origin(slot: Column, section: Column, per_side: int = 32, edge: int = 16) -> list[Column]:
    """Origin of a tile in its region's grid."""
    return [(F.floor(slot / per_side) * edge).cast("int").alias("x0"), (section * edge).cast("int").alias("y0"), (slot % per_side * edge).cast("int").alias("z0")]


def region_position(pos: Column, slot: Column, section: Column, s: int, per_side: int = 32) -> Column:
    """Place in the region's grid of a tile's cell: the region is per_side tiles along x and z, y outermost."""
    x, y, z = coordinates(pos, s)
    x0, y0, z0 = tile_origin(slot, section, per_side, s)
    side = F.lit(per_side * s).cast("long")
    return (y0 + y) * side * side + (z0 + z) * side + (x0 + x)


def read_cell(cells: DataFrame, key: str, at: Column, n: int, missing: int = 0) -> DataFrame:
    """(key, pos, atom): the cell at that place of each key; missing where it isn't stored, nothing outside the grid."""
    found = F.max(F.when(F.col("pos") == at, F.struct("atom")))["atom"]
    place = F.first(at).cast("int")
    return cells.groupBy(key).agg(place.alias("pos"), F.coalesce(found, F.lit(missing)).alias("atom")).where(F.col("pos").between(0, n - 1))


def write_cell(cells: DataFrame, at: Column, atom: Column) -> DataFrame:
    """cells with another atom where pos is at."""
    return cells.withColumn("atom", F.when(F.col("pos") == at, atom).otherwise(F.col("atom")).cast("int"))


def constant(keys: DataFrame, key: str, n: int, atom: Column) -> DataFrame:
    """(key, pos, atom): a grid of one atom for each key."""
    return keys.select(key, atom.cast("int").alias("atom"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos")).select(key, "pos", "atom")


def _tiles(cells: DataFrame, key: str, n: int, missing: int, fields: str, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """One shuffle: tiles as rows, then work(atoms, present), both (tiles, n), gives the tile of each output row and its columns."""
    gathered = cells.select(key, F.col("pos").cast("int").alias("pos"), F.col("atom").cast("int").alias("atom")).groupBy(key)
    gathered = gathered.agg(F.collect_list("pos").alias("pos"), F.collect_list("atom").alias("atom"))  # both skip nulls, which cells don't have
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_CELLS // n)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                pos, atom = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy()))
                fits = (pos >= 0) & (pos < n)
                dense, present = np.full((part.num_rows, n), missing, np.int32), np.zeros((part.num_rows, n), bool)
                dense[row[fits], pos[fits]] = atom[fits]
                present[row[fits], pos[fits]] = True
                of, columns = work(dense, present)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], names=[key, *names])

    kind = cells.schema[key].dataType.simpleString()
    return gathered.mapInArrow(run, f"{key} {kind}, {fields}")


def shifted(dense: np.ndarray, s: int) -> np.ndarray:
    """The causal neighbours of every cell, (twelve, tiles, cells), BORDER outside the tile."""
    wide = np.full((len(dense), s + 2, s + 2, s + 3), BORDER, dense.dtype)
    wide[:, 2:, 2:, 2 : s + 2] = dense.reshape(-1, s, s, s)
    near = [wide[:, 2 + dy : 2 + dy + s, 2 + dz : 2 + dz + s, 2 + dx : 2 + dx + s].reshape(len(dense), -1) for dx, dy, dz in REACH]
    return np.stack(near)


def neighbours(cells: DataFrame, key: str, s: int) -> DataFrame:
    """(key, pos, atom, and the twelve causal neighbours by NEAR) of every stored cell; BORDER where none is stored."""

    def work(dense: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        of, pos = np.nonzero(present)
        return of, [pa.array(v.astype(np.int32)) for v in (pos, dense[of, pos], *shifted(dense, s)[:, of, pos])]

    return _tiles(cells, key, s**3, BORDER, "pos int, atom int, " + ", ".join(f"{n} int" for n in NEAR), work)


def primary_vote(cells: DataFrame, key: str, s: int, least: int = 1) -> DataFrame:
    """(key, pos, atom, primary_value, mismatches, band) of every cell.

    Neighbours whose atom has least or more cells in the tile are members of its palette and win over others.
    Then the weighted votes count, then the value whose last voter comes earliest, then the first.
    """

    def work(dense: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        near = shifted(dense, s)[: len(VOTES)]
        inside = near != BORDER
        same = near[:, None] == near[None]  # voter, voter
        votes = np.einsum("k,jk...->j...", np.array(VOTES), same)
        last = (same * np.arange(1, len(VOTES) + 1)[None, :, None, None]).max(axis=1)
        order = np.sort(dense, axis=1)
        counts = np.stack([np.searchsorted(o, v.ravel(), "right") - np.searchsorted(o, v.ravel(), "left") for o, v in zip(order, near.transpose(1, 0, 2), strict=True)])
        member = counts.reshape(len(dense), len(VOTES), -1).transpose(1, 0, 2) >= least
        rank = np.where(inside, (member * 64 + votes) * 16 - last, -1)
        best = np.take_along_axis(near, rank.argmax(axis=0)[None], axis=0)[0]
        wrong = (inside & (near != best)).sum(axis=0)
        band = np.array([0, 1, 2, 2, 3, 3, 3, 3, 3, 3])[wrong]
        of = np.repeat(np.arange(len(dense)), dense.shape[1])
        pos = np.tile(np.arange(dense.shape[1]), len(dense))
        return of, [pa.array(v.ravel().astype(np.int32)) for v in (pos, dense, best, wrong, band)]

    return _tiles(cells, key, s**3, BORDER, "pos int, atom int, primary_value int, mismatches int, band int", work)


def mismatch_band(n: Column) -> Column:
    return F.when(n == 0, 0).when(n == 1, 1).when(n <= 3, 2).otherwise(3)


def fill_grid(cells: DataFrame, key: str, n: int, missing: int) -> DataFrame:
    """(key, pos, atom) for every pos < n; absent cells have the missing atom."""

    def work(dense: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        pos = np.tile(np.arange(n, dtype=np.int32), len(dense))
        return np.repeat(np.arange(len(dense)), n), [pa.array(pos), pa.array(dense.ravel())]

    return _tiles(cells, key, n, missing, "pos int, atom int", work)


def sections_of(cells: DataFrame, key: str, n: int, missing: int = 0) -> DataFrame:
    """(key, atoms array<int>): whole tiles as one row each, as files take them."""

    def work(dense: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        ends = np.arange(len(dense) + 1, dtype=np.int32) * n
        return np.arange(len(dense)), [pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.ravel()))]

    return _tiles(cells, key, n, missing, "atoms array<int>", work)


def rank_grid(cells: DataFrame, key: str, n: int, atom: int = 0) -> DataFrame:
    """(key, pos, rank) for every pos < n: ranks of atoms by count over all tiles, then by atom.

    Absent cells are of the given atom, so they count for it: its count is topped up by all that isn't stored.
    """
    tiles = cells.select(key).distinct().count()
    sums = cells.where(F.col("pos").between(0, n - 1)).groupBy("atom").agg(F.count("*").alias("n"))
    gaps = cells.sparkSession.createDataFrame([(atom, tiles * n)], "atom int, n long")  # one row
    stored = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stored"))
    gaps = gaps.join(F.broadcast(stored), F.lit(True)).select("atom", (F.col("n") - F.col("stored")).alias("n"))
    from .dictionary import rank_sums

    ranks = rank_sums(sums.unionByName(gaps).groupBy("atom").agg(F.sum("n").alias("n")).where("n > 0"))
    # Atoms are 16-bit, so this table has at most 65 536 rows.
    return fill_grid(cells, key, n, atom).join(F.broadcast(ranks.select("atom", "rank")), "atom").select(key, "pos", "rank")

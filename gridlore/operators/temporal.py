"""Newest-first histories: reverse deltas, as-of, nearest, newest-k, state logs, keyed change feeds.

A history is rows of (keys..., ts, value). Everything is one grouped aggregate or one window per key;
timestamps are long microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: "unchanged" in a stored reverse delta. Input values must not use it.
UNCHANGED = 65535


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def asof(df: DataFrame, keys: Sequence[str], ts: str, value: str, at: int) -> DataFrame:
    """Value at the newest ts <= at; before the oldest snapshot the oldest one counts."""
    before = F.max_by(value, F.when(F.col(ts) <= at, F.col(ts)))
    any_before = F.max(F.when(F.col(ts) <= at, 1))
    oldest = F.min_by(value, ts)
    return df.groupBy(*keys).agg(F.when(any_before.isNotNull(), before).otherwise(oldest).alias(value))


def asof_join(probes: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Each probe (keys, ts) with the history value as of it, clamped to the oldest; null without history.

    Union and one window instead of a range join: linear in rows, one shuffle on the keys.
    """
    both = probes.select(*keys, ts, F.lit(None).cast(history.schema[value].dataType).alias(value), F.lit(1).alias("probe")).unionAll(
        history.select(*keys, ts, value, F.lit(0).alias("probe"))
    )
    w = Window.partitionBy(*keys).orderBy(ts, "probe")
    seen = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    oldest = F.first(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("found", F.coalesce(seen, oldest)).where("probe = 1").select(*keys, ts, F.col("found").alias(value))


def with_level(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """level 0 is the newest."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("level", (F.row_number().over(w) - 1).cast("int"))


def newest_k(df: DataFrame, keys: Sequence[str], ts: str, k: int) -> DataFrame:
    """k = 0: all. The rank filter is pushed below the shuffle by the engine's group limit."""
    out = with_level(df, keys, ts)
    return out.where(F.col("level") < k) if k else out


def nearest_ts(df: DataFrame, keys: Sequence[str], ts: str, at: int) -> DataFrame:
    """The stored timestamp closest to at; ties go to the newer, which is listed first."""
    return df.groupBy(*keys).agg(F.min_by(ts, F.struct(F.abs(F.col(ts) - at), -F.col(ts))).alias("nearest"))


def snapshot_nearest(df: DataFrame, keys: Sequence[str], ts: str, value: str, at: int) -> DataFrame:
    """Value as of the nearest stored timestamp; that timestamp is in the history, so no clamp is needed."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(ts, value), F.struct(F.abs(F.col(ts) - at), -F.col(ts))).alias("s")).select(
        *keys, F.col(f"s.{ts}").alias("nearest"), F.col(f"s.{value}").alias(value)
    )


def carry_grid(df: DataFrame, entity: str, cell: str, cells: Sequence[str], ts: str, value: str, missing: int = 0) -> DataFrame:
    """(entity, ts, pos, atom): the full grid at every ts, cells keep their last value. One window for all cells."""
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.coalesce(F.last(F.when(F.col(cell) == c, F.col(value)), True).over(w), F.lit(missing)) for c in cells]
    return df.select(entity, ts, F.array(*last).alias("grid")).select(entity, ts, F.posexplode("grid").alias("pos", "atom"))


def drop_unchanged(grid: DataFrame, entity: str, ts: str) -> DataFrame:
    """Snapshots that equal their predecessor in every cell go (the oldest always stays)."""
    w = Window.partitionBy(entity, "pos").orderBy(ts)
    before = F.lag("atom").over(w)
    marked = grid.withColumn("moved", (before.isNull() | (F.col("atom") != before)).cast("int"))
    # The grid's rows of one ts are partitioned alike, so this second window needs no new shuffle on entity.
    return marked.withColumn("any", F.max("moved").over(Window.partitionBy(entity, ts))).where("any = 1").drop("any", "moved")


def reverse_delta(grid: DataFrame, entity: str, ts: str) -> DataFrame:
    """enc: the newest level holds values, every older one its value where the next newer differs, else UNCHANGED."""
    w = Window.partitionBy(entity, "pos").orderBy(F.col(ts).desc())
    newer = F.lag("atom").over(w)
    enc = F.when(newer.isNull(), F.col("atom")).when(newer != F.col("atom"), F.col("atom")).otherwise(UNCHANGED)
    return grid.select(entity, ts, "pos", (F.row_number().over(w) - 1).cast("int").alias("level"), enc.cast("int").alias("enc"))


def reconstruct(encoded: DataFrame, entity: str) -> DataFrame:
    """Inverse of reverse_delta at every level."""
    w = Window.partitionBy(entity, "pos").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return encoded.withColumn("atom", F.last(F.nullif("enc", F.lit(UNCHANGED)), True).over(w)).drop("enc")


def change_counts(encoded: DataFrame, entity: str, ts: str) -> DataFrame:
    """Changed cells of each insert: the number of cells for the first, else what the older level stores."""
    per = encoded.groupBy(entity, ts, "level").agg(F.count_if(F.col("enc") != UNCHANGED).alias("stored"), F.count("*").alias("cells"))
    older = F.lead("stored").over(Window.partitionBy(entity).orderBy("level"))
    return per.select(entity, ts, F.coalesce(older, "cells").cast("long").alias("changes"))


def state_log(df: DataFrame, keys: Sequence[str], ts: str, state: str, tie: str) -> DataFrame:
    """Accepted transitions: newer than the last accepted one, and another state. Equal times are taken in the order of tie.

    Of one time the first state counts, or if that is the log's own, the first other one. Where no time of a key has
    two states, that is a lag. The histories of other keys are folded row by row, in batches of a sorted partition.
    """
    first = F.first(state).over(Window.partitionBy(*keys, ts).orderBy(tie))
    times = df.withColumn("_first", first).groupBy(*keys, ts).agg(
        F.first("_first").alias("_first"), F.min_by(state, F.when(F.col(state) != F.col("_first"), F.col(tie))).alias("_other")
    )
    of_key = Window.partitionBy(*keys)
    # The window leaves the rows partitioned by the keys, so that the sort below needs no other shuffle.
    times = times.withColumn("_mixed", F.count("_other").over(of_key) > 0).withColumn("_before", F.lag("_first").over(of_key.orderBy(ts)))
    plain = times.where(~F.col("_mixed") & (F.col("_before").isNull() | (F.col("_before") != F.col("_first"))))
    plain = plain.select(*keys, ts, F.col("_first").alias(state))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    width = len(keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, now = None, None
        for frame in frames:
            kept = []
            for row in frame.itertuples(index=False):
                key = row[:width]
                if key != of:
                    of, now = key, None
                taken = next((v for v in row[width + 1 :] if v is not None and v != now), None)
                if taken is not None:
                    now = taken
                    kept.append((*row[: width + 1], taken))
            yield pd.DataFrame(kept, columns=[*keys, ts, state])

    mixed = times.where("_mixed").select(*keys, ts, "_first", "_other").sortWithinPartitions(*keys, ts)
    return plain.unionByName(mixed.mapInPandas(fold, kinds))


def state_asof(log: DataFrame, keys: Sequence[str], ts: str, state: str, at: int) -> DataFrame:
    """As-of with clamp; the reported timestamp is the one asked for."""
    return asof(log, keys, ts, state, at).withColumn(ts, F.lit(at).cast("long"))


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Reverse delta of two keyed sets: new keys Erase, changed and vanished keys Put their old value."""
    a, b = old.select(*keys, F.col(value).alias("was"), F.lit(1).alias("in_old")), new.select(*keys, F.col(value).alias("now"), F.lit(1).alias("in_new"))
    both = a.join(b, list(keys), "full")
    op = F.when(F.col("in_old").isNull(), "erase").when(F.col("in_new").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "put")
    return both.select(*keys, op.alias("op"), F.when(op == "put", F.col("was")).alias(value)).where("op is not null")


def keyed_replay(feed: DataFrame, keys: Sequence[str], pos: str, target: int) -> DataFrame:
    """The keyed set at level target: the oldest operation not beyond it wins, Erase drops; level-0 Erase is ignored."""
    useful = feed.where((F.col("level") <= target) & ~((F.col("level") == 0) & (F.col("op") == "erase")))
    won = useful.groupBy(*keys, pos).agg(F.max_by(F.struct("op", "value"), "level").alias("won"))
    return won.where("won.op = 'put'").select(*keys, pos, F.col("won.value").alias("value"))


def replay_all(feed: DataFrame, keys: Sequence[str], pos: str, levels: int) -> DataFrame:
    """keyed_replay for levels 0 .. levels - 1 in one pass: an operation is sent to the levels it may serve."""
    useful = feed.where((F.col("level") < levels) & ~((F.col("level") == 0) & (F.col("op") == "erase")))
    sent = useful.withColumn("at", F.explode(F.sequence("level", F.lit(levels - 1))))
    won = sent.groupBy(*keys, "at", pos).agg(F.max_by(F.struct("op", "value"), "level").alias("won"))
    return won.where("won.op = 'put'").select(*keys, "at", pos, F.col("won.value").alias("value"))


def replay_levels(feed: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """keyed_replay for every level that the keys have: an operation serves from its level to before the next older one of its pos."""
    last = F.max("level").over(Window.partitionBy(*keys))  # level-0 Erases count as levels, so before they go
    useful = feed.withColumn("last", last).where(~((F.col("level") == 0) & (F.col("op") == "erase")))
    # The rows of one pos are partitioned alike, so this second window needs no new shuffle on the keys.
    older = F.lead("level").over(Window.partitionBy(*keys, pos).orderBy("level"))
    until = useful.withColumn("until", F.coalesce(older - 1, "last")).where("op = 'put' AND until >= level")
    return until.select(*keys, F.explode(F.sequence("level", "until")).alias("at"), pos, "value")


def complete_asof(df: DataFrame, entity: str, cell: str, n_cells: int, ts: str, value: str, at: int) -> DataFrame:
    """As-of over all cells; entities that lack a cell are dropped."""
    cells = asof(df, [entity, cell], ts, value, at)
    return cells.withColumn("n", F.count("*").over(Window.partitionBy(entity))).where(F.col("n") == n_cells).drop("n")


def min_latest(df: DataFrame, entity: str, cell: str, n_cells: int, ts: str) -> DataFrame:
    """Smallest of the cells' newest timestamps, for complete entities."""
    latest = df.groupBy(entity, cell).agg(F.max(ts).alias("latest"))
    return latest.groupBy(entity).agg(F.min("latest").alias("min_latest"), F.count("*").alias("n")).where(F.col("n") == n_cells).drop("n")


def complete_nearest(df: DataFrame, entity: str, cell: str, n_cells: int, ts: str, value: str, at: int) -> DataFrame:
    """snapshot_nearest of every cell; entities that lack a cell are dropped."""
    cells = snapshot_nearest(df, [entity, cell], ts, value, at)
    return cells.withColumn("n", F.count("*").over(Window.partitionBy(entity))).where(F.col("n") == n_cells).drop("n")


def complete_latest(df: DataFrame, entity: str, cell: str, n_cells: int, ts: str, value: str) -> DataFrame:
    """Every cell's newest value with the smallest of the entity's newest timestamps, for complete entities."""
    newest = df.groupBy(entity, cell).agg(F.max(F.struct(ts, value)).alias("s"))
    w = Window.partitionBy(entity)
    out = newest.withColumn("n", F.count("*").over(w)).withColumn("min_latest", F.min(f"s.{ts}").over(w)).where(F.col("n") == n_cells)
    return out.select(entity, cell, F.col(f"s.{value}").alias(value), "min_latest")


def update_changes(old: DataFrame, updates: DataFrame, entity: str, cell: str, value: str) -> DataFrame:
    """Cells that an update changes, summed by entity; cells without a counterpart don't count."""
    both = old.select(entity, cell, F.col(value).alias("was")).join(updates.select(entity, cell, F.col(value).alias("now")), [entity, cell])
    return both.groupBy(entity).agg(F.count_if(F.col("was") != F.col("now")).alias("changes"))


def timeline(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenation in the listed order, duplicates kept; ord says which part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("ord", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def chunk_timestamp(line: DataFrame, keys: Sequence[str], ts: str, at: int) -> DataFrame:
    """Nearest listed timestamp (ties: earlier part, then newer) clamped to unsigned 32 bits."""
    near = line.groupBy(*keys).agg(F.min_by(ts, F.struct(F.abs(F.col(ts) - at), "ord", -F.col(ts))).alias("t"))
    return near.select(*keys, F.least(F.greatest("t", F.lit(0)), F.lit(4294967295)).cast("long").alias("chunk_ts"))

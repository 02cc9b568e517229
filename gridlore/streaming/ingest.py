"""Streaming ingest of sparse snapshots into reverse-delta pairs, keyed by entity.

State of a key: its newest accepted timestamp and cells. Rows of a micro-batch are replayed in arrival
order (column seq): a snapshot that isn't newer than the newest accepted one is late, one that changes
nothing is a no-op; neither moves the state. An accepted one gives the reverse delta of the cells that
it changes (old values, null for new cells) and the new values, so an append-only sink holds the
whole history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity long, ts long, status string, changes int, old string, new string"


def _replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(batches)
    newest, cells = (state.get if state.exists else (None, "{}"))
    grid = json.loads(cells)
    out = []
    for ts, part in sorted(rows.groupby("ts", sort=False), key=lambda x: x[1]["seq"].min()):
        seen = {str(c): int(v) for c, v in part.sort_values("seq")[["cell", "value"]].itertuples(index=False)}
        changed = {c: v for c, v in seen.items() if grid.get(c) != v}
        if newest is not None and ts <= newest:
            status, changed = "late", {}
        elif not changed:
            status = "unchanged"
        else:
            status = "accepted"
        old = {c: grid.get(c) for c in changed}
        if status == "accepted":
            grid |= changed
            newest = int(ts)
        out.append((key[0], int(ts), status, len(changed), json.dumps(old, sort_keys=True), json.dumps(changed, sort_keys=True)))
    if newest is not None:
        state.update((newest, json.dumps(grid)))
    yield pd.DataFrame(out, columns=["entity", "ts", "status", "changes", "old", "new"])


def ingest(stream: DataFrame) -> DataFrame:
    """stream: entity long, ts long, cell string, value int, seq long."""
    return stream.groupBy("entity").applyInPandasWithState(_replay, OUTPUT, "newest long, cells string", "append", GroupStateTimeout.NoTimeout)


LOG = "entity long, ts long, state string"


def _log(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, last = state.get if state.exists else (None, None)
    out = []
    for at, _, now in pd.concat(batches)[["ts", "seq", "state"]].sort_values(["ts", "seq"]).itertuples(index=False):
        if ts is None or (at > ts and now != last):
            ts, last = int(at), now
            out.append((key[0], ts, last))
    state.update((ts, last))
    yield pd.DataFrame(out, columns=["entity", "ts", "state"])


def state_log(stream: DataFrame) -> DataFrame:
    """Accepted transitions of entity long, ts long, state string, seq long: newer than the last one and another state.

    A micro-batch's rows are taken in the order of ts and seq; rows of a later batch that aren't newer are late and go.
    """
    return stream.groupBy("entity").applyInPandasWithState(_log, LOG, "ts long, state string", "append", GroupStateTimeout.NoTimeout)

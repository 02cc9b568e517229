"""Progress while a job runs: metrics that travel with it, listeners for streams, and streams that end as tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.file_sink import scratch_folder


def observed(outcomes: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """outcomes (error, in_bytes, out_bytes, voxels) and their counters, which are known when an action on it ends; no extra job."""
    seen = Observation(name)
    failed = F.col("error").isNotNull()
    counters = [
        F.count(F.lit(1)).alias("done"), F.count_if(failed).alias("failed"),
        *(F.coalesce(F.sum(F.when(~failed, F.col(c))), F.lit(0)).alias(c) for c in ("in_bytes", "out_bytes", "voxels") if c in outcomes.columns),
    ]
    return outcomes.observe(seen, *counters), seen


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds that the rest takes at the pace so far; 0 before the first is done."""
    return F.when(done > 0, elapsed / done * (total - done)).otherwise(0.0)


def status_line(done: int, total: int, failed: int, in_bytes: int, seconds: float) -> str:
    rate = in_bytes / 1e6 / seconds if seconds > 0 else 0.0
    rest = seconds / done * (total - done) if done else 0.0
    return f"[{done}/{total}] failed={failed} | {rate:.1f} MB/s | {rest:.1f}s left"


class StreamProgress(StreamingQueryListener):
    """Calls report(line) for each micro-batch of every query of the session, with rows so far and their pace."""

    def __init__(self, report: Callable[[str], None]) -> None:
        self.report, self.rows, self.start = report, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.start = time.monotonic()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.report(f"batch {p.batchId}: {self.rows} rows | {self.rows / max(time.monotonic() - self.start, 1e-9):.0f} rows/s")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report("failed" if event.exception else "complete")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives until its input ends, as a table in the shared folder; its checkpoint lies beside it."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, label)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

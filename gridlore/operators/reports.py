"""Run reports of outcome rows (path, step, ok, sizes): sums, first failures, ratio and phase lines, exit status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_bytes, format_rate


def first_failures(rows: DataFrame, ok: Column, path: str, columns: list[str], n: int = 10) -> DataFrame:
    """The first n failures by path; n is the report's size. Ordered in one pass that keeps n rows a task."""
    return rows.where(~ok).select(path, *columns).orderBy(path, *columns).limit(n)


def ratio_line(label: str, before: Column, after: Column, kilo: str = "KB", width: int = 10, nothing: str | None = None) -> Column:
    """'label     : +1.50 KB (+12.5%)'; nothing where there was nothing before."""
    delta, sign = after - before, F.when(after >= before, "+").otherwise("-")
    percent = F.format_string("%.1f", F.abs(delta.cast("double") / before * 100))
    line = F.concat(F.lit(f"{label:<{width}}: "), sign, format_bytes(F.abs(delta), kilo), F.lit(" ("), sign, percent, F.lit("%)"))
    return F.when(before == 0, F.lit(nothing)).otherwise(line)


def phase_line(label: str, in_bytes: Column, voxels: Column, ns: Column) -> Column:
    """Megabytes and voxels a second of a phase; n/a where it took no time."""
    seconds, took = ns.cast("double") / 1e9, F.format_string("(%.0f ms aggregate)", ns.cast("double") / 1e6)
    rates = F.concat(F.format_string("%5.1f MB/s | ", in_bytes / seconds / 1e6), format_rate(voxels / seconds, "voxel"), F.lit(" "), took)
    return F.concat(F.lit(f"{label} "), F.when(ns == 0, F.concat(F.lit("n/a  "), took)).otherwise(rates))


def run_report(sums: DataFrame, seconds: Column) -> DataFrame:
    """sums (files, failed, skipped, in_bytes, ...) with ok, megabytes a second, and the exit status: 1 after a failure."""
    ok = F.col("files") - F.col("failed") - F.col("skipped")
    rate = F.when(seconds > 0, F.col("in_bytes") / 1e6 / seconds).otherwise(0.0)
    return sums.withColumn("ok", ok).withColumn("mb_s", rate).withColumn("status", F.when(F.col("failed") > 0, 1).otherwise(0))


def first_decodable(outcomes: DataFrame, length: str = "length", path: str = "path") -> DataFrame:
    """The smallest file that decodes (error is null), then the first path: a minimum, not a sort."""
    best = outcomes.where("error IS NULL").agg(F.min(F.struct(length, path)).alias("b")).where("b IS NOT NULL")
    return best.select(F.col(f"b.{length}").alias(length), F.col(f"b.{path}").alias(path))

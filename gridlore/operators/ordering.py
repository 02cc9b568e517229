"""Global order without a single-task sort: ranges with fixed bounds, range totals, then order inside ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows that a range holds by design, and the most and fewest ranges.
RANGE_ROWS, MOST_RANGES, LEAST_RANGES = 1_000_000, 4096, 8


def range_count(rows: int) -> int:
    return min(MOST_RANGES, max(LEAST_RANGES, -(-rows // RANGE_ROWS)))


def ranges(df: DataFrame, order: str, n: int) -> Column:
    """Number of the range of a numeric order column; bounds are approximate quantiles, at most n - 1 of them."""
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)


def running_sum(df: DataFrame, order: str, value: Column, name: str, n: int | None = None, inclusive: bool = False) -> DataFrame:
    """Sum of value over all rows before (or up to) each row in the global order of a unique numeric column.

    n ranges, by default as many as the rows ask for.
    """
    n = n or range_count(df.count())
    dealt = df.withColumn("_v", value).withColumn("_range", ranges(df, order, n))
    totals = dealt.groupBy("_range").agg(F.sum("_v").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # at most n rows
    w = Window.partitionBy("_range").orderBy(order)
    inside = F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(totals), "_range")
    return out.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_v", "_range", "_inside", "_before")


def row_numbers(df: DataFrame, order: str, name: str = "idx", n: int | None = None) -> DataFrame:
    """Zero-based position in the global order of a unique numeric column."""
    return running_sum(df, order, F.lit(1), name, n)


def sample_evenly(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows at positions i * total div n for i < n; all rows if n >= total."""
    total = df.count()
    if n >= total:
        return df
    at = F.col("idx")
    # Position p is taken if some i has i * total div n = p: the smallest i with i * total >= p * n gives it.
    i = F.floor((at * n + total - 1) / F.lit(total)).cast("long")
    exact = F.floor(i * total / F.lit(n)).cast("long")
    return row_numbers(df, order).where((exact == at) & (i < n)).drop("idx")

"""Distributed prefix sums and order-preserving cells, without global windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, each: int = 100_000) -> int:
    """A power of two, 256 at least: enough buckets for a third of ``rows`` to come as ``each`` a bucket or fewer."""
    return max(256, 1 << max(0, math.ceil(math.log2(max(1, rows / 3 / each)))))


def stream_offsets(df: DataFrame, key: str, size: str, order: list, out: str, buckets: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the same ``key`` before this row.

    ``order[0]`` must be a hash column of type long: its top bits split each key
    into ``buckets`` sub-streams, so a key that holds a third of all rows is
    sorted by many tasks. Bucket totals are pre-aggregated and their prefix sums
    (at most ``buckets`` rows a key) joined back.
    """
    shift = 64 - int(math.log2(buckets))
    rows = df.withColumn("__bucket", F.shiftrightunsigned(F.col(order[0]), shift))
    totals = rows.groupBy(key, "__bucket").agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(key).alias("__k"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")
    )
    inner = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return (
        rows.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, F.col("__base") + F.col("__within"))
        .drop("__bucket", "__k", "__b", "__base", "__within")
    )


def sums_before(sums: DataFrame, at: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """``sums`` (one row a number ``at``) with ``out``: the sum of ``value`` over all lesser numbers.

    Two levels: spans of numbers are summed first, so no task orders all of them.
    """
    rows = sums.withColumn("__span", F.floor(F.col(at) / span))
    spans = rows.groupBy("__span").agg(F.sum(value).alias("__sum"))
    below = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("__span", F.coalesce(F.sum("__sum").over(below), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(spans, "__span")
    return rows.withColumn(out, F.col("__base") + F.col("__within")).drop("__span", "__base", "__within")


def ordered_cells(df: DataFrame, col: str, rows_per_cell: int, quantiles: int | None = None) -> Column:
    """A long expression that grows with the integer column ``col``, about ``rows_per_cell`` rows a value.

    Approximate quantiles (one narrow pass) bound the intervals, each cut into equal
    widths; an outlier or a cluster of ids thus spoils one interval only. There is
    one for 50,000 rows, 256 to 4,096 of them. NULL falls in cell -1, below all others.
    """
    if quantiles is None:
        quantiles = min(4096, max(256, df.count() // 50_000))
    shares = [i / quantiles for i in range(quantiles + 1)]
    n, marks = df.agg(F.count(col), F.percentile_approx(col, shares, max(10_000, 8 * quantiles))).first()
    bounds = sorted(set(marks or [0]))
    bounds = bounds[:: max(1, len(bounds) * rows_per_cell // max(n, 1))]  # fewer cells than quantiles will do
    sub = max(1, math.ceil(math.ceil((n or 0) / rows_per_cell) / max(1, len(bounds) - 1)))
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    steps = [2**k for k in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    x = F.col(col).cast("long")
    index = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: at + F.when((at + s < len(bounds)) & (F.get(edges, at + s) <= x), s).otherwise(0),
    )
    widths = [max(1.0, (b - a) / sub) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)]
    low, width = F.get(edges, index).cast("double"), F.get(F.array(*[F.lit(w) for w in widths]), index)
    part = F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor((x.cast("double") - low) / width)))
    return F.when(x.isNull(), F.lit(-1)).otherwise(index * F.lit(sub).cast("long") + part).cast("long")

"""The pipeline's stages as one call each: grid, tuning, smoothing, annotation, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import describe, detect, gaps, smooth
from tidemark.series import SeriesSpec


def preprocess(df: DataFrame, spec: SeriesSpec, roster: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid, log) of raw readings: the gap-filled grid and one log row (series, status, reason, n_rows, n_filled) a series.

    Series whose readings have no time, and series of ``roster`` (series) without
    readings, fail.
    """
    rows = spec.normalise(df)
    grid = gaps.gap_fill(rows)
    done = grid.groupBy("series").agg(F.count("*").alias("n_rows"), F.sum("gap_flag").alias("n_filled"))
    known = df.select(F.expr(spec.key).alias("series")).distinct().withColumn("__read", F.lit(True))
    if roster is not None:
        known = known.join(roster.select("series").distinct(), "series", "full")
    log = known.join(done, "series", "left")
    reason = F.when(F.col("__read").isNull(), "no readings found").when(F.col("n_rows").isNull(), "no reading has a time")
    return grid, log.select("series", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("reason"), "n_rows", "n_filled")


def smooth_grid(df: DataFrame, spec: SeriesSpec, method: str) -> tuple[DataFrame, DataFrame]:
    """(grid with smoothed values, log): smoothed readings merged back into the grid, gaps left NULL."""
    rows = spec.normalise(df)
    done = smooth.smooth_smc(rows) if method == "smc" else smooth.smooth(rows, method)
    if method == "smc":
        done = done.withColumnRenamed("segment_id", "chunk_id")
    cols = [c for c in ("smoothed", "trend", "low", "high", "chunk_id") if c in done.columns]
    grid = gaps.merge_back(gaps.gap_fill(rows), done, *cols)
    return grid, smooth.smoothing_log(rows, done)


def backfill_trend(grid: DataFrame) -> DataFrame:
    """A centred 24-hour mean as an approximate trend for tables without one; core columns first."""
    out = describe.centred_mean(grid)
    core = ["series", "ts", "value", "minute_diff", "trend", "gap_flag"]
    return out.select(*[c for c in core if c in out.columns], *[c for c in out.columns if c not in core])


def annotate(df: DataFrame, spec: SeriesSpec, method: str = "kim") -> DataFrame:
    """Smoothed readings with all detectors' types and degrees."""
    return detect.annotate(smooth.smooth(spec.normalise(df), method))

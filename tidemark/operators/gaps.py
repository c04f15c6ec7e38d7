"""Steps, gaps, chunks, islands, and the explicit grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.series import MINUTE, from_micros, micros, observed, ordered

GAP_MINUTES = 180
GRID_MINUTES = 10


def step_minutes(over=None) -> Column:
    """Minutes since the row before; NULL on a series' first row."""
    over = over if over is not None else ordered()
    return (F.col("us") - F.lag("us").over(over)) / MINUTE


def with_steps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("minute_diff", step_minutes())


def gap_fill(rows: DataFrame, gap: float = GAP_MINUTES, grid: float = GRID_MINUTES) -> DataFrame:
    """Makes gaps explicit: after a step over ``gap`` minutes, rows without value every ``grid`` minutes up to the next reading.

    Adds gap_flag (1: no value) and minute_diff of the filled grid. One scan, one
    exchange and one window: each reading brings the rows that follow it, and the
    step to the last of those before it is known from the reading before.
    """
    step, here = int(grid * MINUTE), F.col("us")
    wide = rows.select("series", "ts", "row_id", "value", "us", F.lag("us").over(ordered()).alias("__prev"), F.lead("us").over(ordered()).alias("__next"))
    upto = F.when(F.col("__next") - here > gap * MINUTE, F.greatest(here, F.col("__next") - 1)).otherwise(here)
    back = here - F.col("__prev")
    past = F.when(back > gap * MINUTE, (back - 1) % step + 1).otherwise(back)
    wide = wide.select("series", "ts", "row_id", "value", past.alias("__back"), F.posexplode(F.sequence(here, upto, F.lit(step).cast("long"))).alias("__i", "us"))
    own = F.col("__i") == 0
    return wide.select(
        "series", F.when(own, F.col("ts")).otherwise(from_micros("us")).alias("ts"), F.when(own, F.col("row_id")).alias("row_id"), F.when(own, F.col("value")).alias("value"), "us",
        (F.when(own, F.col("__back")).otherwise(step) / MINUTE).alias("minute_diff"), F.when(own & observed(), 0).otherwise(1).alias("gap_flag"),
    )


def chunks(rows: DataFrame, gap: float = GAP_MINUTES) -> DataFrame:
    """Adds time_diff_min, gap_boundary and chunk_id (1, 2, ... in each series): a chunk begins after ``gap`` minutes or more."""
    rows = rows.withColumn("time_diff_min", step_minutes())
    begins = F.col("time_diff_min").isNull() | (F.col("time_diff_min") >= gap)
    rows = rows.withColumn("gap_boundary", begins)
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chunk_id", F.sum(F.col("gap_boundary").cast("long")).over(upto))


def islands(rows: DataFrame) -> DataFrame:
    """Adds segment_id: runs of rows that all have, or all lack, a value."""
    rows = rows.withColumn("observed", observed())
    turn = F.coalesce((F.lag("observed").over(ordered()) != F.col("observed")).cast("long"), F.lit(1))
    rows = rows.withColumn("__turn", turn)
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment_id", F.sum("__turn").over(upto)).drop("__turn")


def longest_segment(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of each series' longest observed island (the first of equals), its first ``most`` rows only if given."""
    seg = islands(rows).where("observed")
    sizes = seg.groupBy("series", "segment_id").agg(F.count("*").alias("n_rows"))
    best = Window.partitionBy("series").orderBy(F.col("n_rows").desc(), "segment_id")
    best = sizes.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    rows = seg.join(best, ["series", "segment_id"])
    if most is None:
        return rows
    return rows.withColumn("__i", F.row_number().over(ordered())).where(F.col("__i") <= most).drop("__i")


def merge_back(grid: DataFrame, smoothed: DataFrame, *cols: str) -> DataFrame:
    """The grid with ``cols`` of the smoothed readings; each reading is met by its own row, so equal times never multiply.

    Time is one of the keys, so that a series' rows without a reading are not one key.
    """
    found = smoothed.withColumn("us", micros("ts")).select("series", "row_id", "us", *cols)
    return grid.join(found, ["series", "row_id", "us"], "left")


def gap_markers(rows: DataFrame, gap: float = GAP_MINUTES) -> DataFrame:
    """(series, gap_start, gap_end, gap_minutes) of steps over ``gap`` between readings with values."""
    seen = rows.where(observed()).withColumn("__last", F.lag("ts").over(ordered())).withColumn("gap_minutes", step_minutes())
    return seen.where(F.col("gap_minutes") > gap).select("series", F.col("__last").alias("gap_start"), F.col("ts").alias("gap_end"), "gap_minutes")


def blank_gaps(rows: DataFrame, cols: list[str]) -> DataFrame:
    """NULL in ``cols`` where gap_flag is 1."""
    return rows.withColumns({c: F.when(F.col("gap_flag") == 0, F.col(c)) for c in cols})

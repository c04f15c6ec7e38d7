"""Descriptive statistics of series; one row a series unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gaps import step_minutes
from tidemark.series import MINUTE, observed, ordered

DAY_ROWS = 144
MAD = 1.4826


_QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def _value_aggs() -> list[Column]:
    v = F.col("value")
    return [
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.array(*[F.lit(x) for x in _QUANTILES.values()])).alias("__q"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis_excess"),
        F.bool_and(v > 0).alias("all_positive"), F.count_if(v <= 0).alias("n_nonpositive"), F.count_if(v > 300).alias("n_above_300"),
    ]


def _with_quantiles(out: DataFrame) -> DataFrame:
    out = out.withColumns({name: F.col("__q")[i] for i, name in enumerate(_QUANTILES)}).drop("__q")
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("range_90", F.col("q95") - F.col("q05"))


def describe(rows: DataFrame) -> DataFrame:
    """Counts, moments (population), exact percentiles and positivity of the values."""
    return _with_quantiles(rows.where(observed()).groupBy("series").agg(*_value_aggs()))


def _grid_aggs(step: Column, grid: float = 10.0) -> list[Column]:
    on = F.abs(step - grid) < 0.5
    return [
        F.median(step).alias("median_step_min"), F.stddev_samp(step).alias("std_step_min"),
        (F.avg(F.when(on, 1.0).otherwise(0.0)) * 100).alias("pct_on_grid_all"), (F.avg(on.cast("double")) * 100).alias("pct_on_grid_steps"),
    ]


def _null_aggs() -> list[Column]:
    return [F.count("*").alias("n_rows"), (F.avg(F.when(observed(), 0.0).otherwise(1.0)) * 100).alias("null_pct")]


def grid_stats(grid: DataFrame) -> DataFrame:
    """``step_stats`` and ``null_rate`` of a filled grid, whose steps are a column, by one aggregation."""
    return grid.groupBy("series").agg(*_grid_aggs(F.col("minute_diff")), *_null_aggs())


def value_stats(rows: DataFrame, within: float = 15.0, lags=(1, 6, 144, 288)) -> DataFrame:
    """What ``describe``, ``bimodality``, ``rolling_std_cv``, ``rolling_mean_ratio``, ``within_diff_stats`` and ``autocorrelation``
    tell of the values, by one sort and one aggregation; NULL where the operator itself has no row."""
    seen = rows.where(observed()).withColumn("__x", F.col("value") - F.avg("value").over(Window.partitionBy("series")))
    seen = seen.withColumns({
        "__d": F.when(step_minutes() <= within, F.col("value") - F.lag("value").over(ordered())),
        "__s": F.stddev_samp("value").over(ordered().rowsBetween(-(DAY_ROWS - 1), 0)), "__m": _trailing_mean(24),
        **{f"__p{k}": F.col("__x") * F.lag("__x", k).over(ordered()) for k in lags},
    })
    total = F.sum(F.col("__x") * F.col("__x"))
    out = seen.groupBy("series").agg(
        *_value_aggs(), *_difference_aggs(), F.stddev_samp("__s").alias("__sd"), F.avg("__s").alias("__sm"), F.var_samp("__m").alias("__vm"), F.var_pop("value").alias("__v"),
        *[(F.sum(f"__p{k}") / F.when(total > 0, total)).alias(f"acf_{k}") for k in lags],
    )
    out = _with_quantiles(out).withColumn("n_diffs", F.when(F.col("n_diffs") > 0, F.col("n_diffs")))
    out = out.withColumn("bimodality", F.when(F.col("n") > 3, _sarle(False))).withColumn("is_bimodal", F.col("bimodality") > 0.555)
    out = out.withColumn("rolling_cv", F.when(F.col("__sm") > 0, F.col("__sd") / F.col("__sm")))
    out = out.withColumn("var_ratio", F.when(F.col("n") >= 24, F.when(F.col("__v") > 0, F.col("__vm") / F.col("__v")).otherwise(0.0)))
    return out.drop("__sd", "__sm", "__vm", "__v")


def null_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series").agg(*_null_aggs())


def _differences(rows: DataFrame, within: float | None = None) -> DataFrame:
    seen = rows.where(observed()).withColumn("__d", F.col("value") - F.lag("value").over(ordered())).withColumn("__dt", step_minutes())
    seen = seen.where("__d IS NOT NULL")
    return seen if within is None else seen.where(F.col("__dt") <= within)


def mad_noise(rows: DataFrame, variant: str = "b") -> DataFrame:
    """Noise of the values from the median absolute first difference.

    a: 1.4826 median|d| / sqrt 2, 1 at least; b: the same of differences centred by
    their median, no floor; c: median|d| / 0.6745; k: 1.4826 of centred
    differences, not divided.
    """
    d = _differences(rows)
    if variant in "bk":
        centre = d.groupBy("series").agg(F.median("__d").alias("__m"))
        d = d.join(centre, "series").withColumn("__d", F.col("__d") - F.col("__m"))
    out = d.groupBy("series").agg(F.median(F.abs("__d")).alias("__mad"))
    scale = {"a": F.greatest(MAD * F.col("__mad") / F.sqrt(F.lit(2.0)), F.lit(1.0)), "b": MAD * F.col("__mad") / F.sqrt(F.lit(2.0)), "c": F.col("__mad") / 0.6745, "k": MAD * F.col("__mad")}
    return out.select("series", scale[variant].alias("sigma"))


def _difference_aggs() -> list[Column]:
    return [
        F.count("__d").alias("n_diffs"), (MAD * F.median(F.abs("__d")) / F.sqrt(F.lit(2.0))).alias("sigma_x"), F.stddev_pop("__d").alias("diff_std"),
        F.kurtosis("__d").alias("diff_kurt"), F.skewness("__d").alias("diff_skew"),
    ]


def within_diff_stats(rows: DataFrame, within: float = 15.0) -> DataFrame:
    """Noise and moments of differences between readings at most ``within`` minutes apart."""
    return _differences(rows, within).groupBy("series").agg(*_difference_aggs())


def hour_profile(rows: DataFrame) -> DataFrame:
    """(series, hour, median_value)."""
    return rows.where(observed()).groupBy("series", F.hour("ts").alias("hour")).agg(F.median("value").alias("median_value"))


def circadian_amplitude(rows: DataFrame) -> DataFrame:
    return hour_profile(rows).groupBy("series").agg((F.max("median_value") - F.min("median_value")).alias("amplitude"))


def step_stats(rows: DataFrame, grid: float = 10.0) -> DataFrame:
    """Median and deviation of steps, and the share on the grid by two denominators: all rows, and rows with a step."""
    return rows.withColumn("__dt", step_minutes()).groupBy("series").agg(*_grid_aggs(F.col("__dt"), grid))


def _sarle(corrected: bool) -> Column:
    n, sk, ku = F.col("n"), F.col("skew"), F.col("kurtosis_excess")
    below = ku + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) + (0 if corrected else 3)
    return F.when(below != 0, (sk * sk + 1) / below)


def bimodality(rows: DataFrame, corrected: bool = False) -> DataFrame:
    """Sarle's coefficient of skewness and excess kurtosis.

    The published study adds 3 to the excess kurtosis once more, so that its
    threshold of 0.555 is out of reach; ``corrected`` leaves that out.
    """
    stats = describe(rows).where("n > 3").withColumn("bimodality", _sarle(corrected))
    return stats.select("series", "bimodality", (F.col("bimodality") > 0.555).alias("is_bimodal"))


def _trailing_mean(width: int) -> Column:
    over = ordered().rowsBetween(-(width - 1), 0)
    return F.when(F.count("value").over(over) >= 2, F.avg("value").over(over))


def rolling_mean_ratio(rows: DataFrame, width: int = 24) -> DataFrame:
    """Sample variance of the trailing mean (two rows at least) over the population variance of the values."""
    rolled = rows.where(observed()).withColumn("__m", _trailing_mean(width))
    out = rolled.groupBy("series").agg(F.count("*").alias("n"), F.var_samp("__m").alias("__a"), F.var_pop("value").alias("__b"))
    return out.where(F.col("n") >= width).select("series", F.when(F.col("__b") > 0, F.col("__a") / F.col("__b")).otherwise(0.0).alias("var_ratio"))


def rolling_std_cv(rows: DataFrame, width: int = DAY_ROWS) -> DataFrame:
    """Variation of the trailing sample deviation."""
    over = ordered().rowsBetween(-(width - 1), 0)
    rolled = rows.where(observed()).withColumn("__s", F.stddev_samp("value").over(over))
    out = rolled.groupBy("series").agg(F.stddev_samp("__s").alias("__a"), F.avg("__s").alias("__b"))
    return out.where("__b > 0").select("series", (F.col("__a") / F.col("__b")).alias("rolling_cv"))


def centred_mean(rows: DataFrame, width: int = DAY_ROWS, least: int = 36, short: int = 36) -> DataFrame:
    """Adds trend: the mean of the ``width`` rows around a row; with fewer than ``least`` values, of ``short`` rows.

    An even window reaches one row further back than ahead. Chunks are ignored,
    and rows in gaps get a trend too.
    """
    over = lambda w: ordered().rowsBetween(-(w // 2), w // 2 - 1)
    long = F.when(F.count("value").over(over(width)) >= least, F.avg("value").over(over(width)))
    return rows.withColumn("trend", F.coalesce(long, F.avg("value").over(over(short))))


def rolling_band(rows: DataFrame, width: int = DAY_ROWS, least: int = 36) -> DataFrame:
    """Adds band_mean and band_std (sample deviation) of the ``width`` rows around a row, NULL with fewer than ``least`` values."""
    over = ordered().rowsBetween(-(width // 2), width // 2 - 1)
    enough = F.count("value").over(over) >= least
    return rows.withColumn("band_mean", F.when(enough, F.avg("value").over(over))).withColumn("band_std", F.when(enough, F.stddev_samp("value").over(over)))


def normal_scores(rows: DataFrame) -> DataFrame:
    """Plot data of a normal quantile plot: (series, row_id, value, share), share the plotting position (i - 1/2) / n."""
    by_value = Window.partitionBy("series").orderBy("value", "us", "row_id")
    n = F.count("*").over(Window.partitionBy("series"))
    return rows.where(observed()).select("series", "row_id", "value", ((F.row_number().over(by_value) - 0.5) / n).alias("share"))


def densest_window(rows: DataFrame, days: int = 3) -> DataFrame:
    """(series, window_start, window_end, n): the first time range of ``days`` (open at its start) with most values."""
    span = days * 24 * 60 * MINUTE
    by_time = Window.partitionBy("series").orderBy("us").rangeBetween(-span + 1, 0)
    counted = rows.where(observed()).withColumn("n", F.count("*").over(by_time))
    first = Window.partitionBy("series").orderBy(F.col("n").desc(), "us", "row_id")
    best = counted.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return best.select("series", F.expr(f"ts - INTERVAL {days} DAY").alias("window_start"), F.col("ts").alias("window_end"), "n")


def autocorrelation(rows: DataFrame, lags=(1, 6, 144, 288)) -> DataFrame:
    """Biased autocorrelation at row lags, as columns acf_<lag>, and the band acf_bound outside of which it is
    not noise's (1.96 / sqrt n); NULL where a series is too short."""
    mean = Window.partitionBy("series")
    x = rows.where(observed()).withColumn("__x", F.col("value") - F.avg("value").over(mean))
    x = x.withColumns({f"__p{k}": F.col("__x") * F.lag("__x", k).over(ordered()) for k in lags})
    total = F.sum(F.col("__x") * F.col("__x"))
    bound = (1.96 / F.sqrt(F.count("*"))).alias("acf_bound")
    return x.groupBy("series").agg(F.count("*").alias("n"), bound, *[(F.sum(f"__p{k}") / F.when(total > 0, total)).alias(f"acf_{k}") for k in lags])


def histogram(rows: DataFrame, bins: int = 60) -> DataFrame:
    """(series, bin, n, bin_low, bin_high): equal bins between a series' least and greatest value; the last bin is closed."""
    ends = Window.partitionBy("series")
    v = rows.where(observed()).withColumn("__lo", F.min("value").over(ends)).withColumn("__hi", F.max("value").over(ends))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))).otherwise(0)
    out = v.groupBy("series", at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("__lo").alias("__lo"), F.min(width).alias("__w"))
    return out.select("series", "bin", "n", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_low"), (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_high"))


def logit(u: Column, eps: float) -> Column:
    u = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), u))
    return F.log(u / (1 - u))

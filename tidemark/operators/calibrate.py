"""Calibration of the smoothers from a series' own observed values: one row a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.describe import MAD, logit, mad_noise
from tidemark.operators.gaps import GAP_MINUTES, step_minutes
from tidemark.series import ordered, positive


def bounds(rows: DataFrame) -> DataFrame:
    """lo, hi and n of the observed values; series with a range under 1 have no bounded model."""
    return rows.where("value IS NOT NULL").groupBy("series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))


def logit_spread(rows: DataFrame, eps: float, floor: float = 0.2) -> DataFrame:
    """(series, z_med, z_spread): median and scaled absolute deviation of the bounded values' logits."""
    z = rows.join(bounds(rows), "series").where("hi > lo AND value IS NOT NULL").withColumn("z", logit((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), eps))
    centre = z.groupBy("series").agg(F.median("z").alias("z_med"))
    dev = z.join(centre, "series").groupBy("series", "z_med").agg(F.median(F.abs(F.col("z") - F.col("z_med"))).alias("mad"))
    return dev.select("series", "z_med", F.greatest(MAD * F.col("mad"), F.lit(floor)).alias("z_spread"))


def smc(segments: DataFrame, whole: DataFrame) -> DataFrame:
    """Parameters of the bounded local-level model for ``segments`` (one contiguous observed run a series), bounds from ``whole``."""
    lim = bounds(whole).where("hi - lo >= 1").drop("n")
    rows = segments.join(lim, "series").withColumn("z", logit((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 1e-6))
    rows = rows.withColumn("dt", step_minutes()).withColumn("i", F.row_number().over(ordered()))
    step = rows.where("dt > 0").groupBy("series").agg(F.median("dt").alias("median_dt"))
    rows = rows.join(step, "series", "left").withColumn("median_dt", F.coalesce("median_dt", F.lit(10.0)))
    rows = rows.withColumn("first_day", F.greatest(F.floor(1440 / F.col("median_dt")), F.lit(50)))
    loc = rows.where("i <= first_day").groupBy("series").agg(F.median("z").alias("z_level_loc"))
    mid = rows.groupBy("series").agg(F.median("z").alias("m"))
    spread = rows.join(mid, "series").groupBy("series", "lo", "hi", "median_dt").agg(F.greatest(MAD * F.median(F.abs(F.col("z") - F.col("m"))), F.lit(0.2)).alias("z_spread"))
    noise = mad_noise(segments, "a").withColumnRenamed("sigma", "sigma_obs")
    out = spread.join(loc, "series").join(noise, "series")
    return out.select(
        "series", "lo", "hi", "z_level_loc", (F.col("z_spread") / 2).alias("z_level_scale"), F.col("z_spread").alias("z_seas_scale"), "sigma_obs",
        (0.02 * F.col("z_spread")).alias("sigma_level"), (2 * F.pi() * F.col("median_dt") / 1440).alias("omega1"), (4 * F.pi() * F.col("median_dt") / 1440).alias("omega2"),
    )


def rspf(rows: DataFrame, regimes: int = 3, circ: float = 0.4, floor: float = 1.0) -> DataFrame:
    """Bounds, regime levels (quantiles of the logits) and scales of the regime-switching filter."""
    rows = rows.where(positive())
    lim = bounds(rows).where("hi > lo")
    z = rows.join(lim.drop("n"), "series").withColumn("z", logit((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 1e-4))
    shares = [0.5] if regimes == 1 else [0.5 / regimes + i * (1 - 1 / regimes) / (regimes - 1) for i in range(regimes)]
    mu = z.groupBy("series").agg(F.percentile("z", F.array(*[F.lit(s) for s in shares])).alias("mu"))
    noise = mad_noise(rows, "b").select("series", F.greatest("sigma", F.lit(floor)).alias("sigma_obs"))
    spread = logit_spread(rows, 1e-4)
    out = lim.join(mu, "series").join(spread, "series").join(noise, "series")
    return out.select("series", "lo", "hi", *[F.col("mu")[i].alias(f"mu_{i}") for i in range(regimes)], "z_spread", "sigma_obs", F.col("z_med").alias("level_loc"), (circ * F.col("z_spread")).alias("circ_amp"))


def reference_step(rows: DataFrame) -> DataFrame:
    """(series, ref_dt): the median step above 0 and below a gap; 10 without any."""
    steps = rows.withColumn("dt", step_minutes())
    inside = F.when((F.col("dt") > 0) & (F.col("dt") < GAP_MINUTES), F.col("dt"))
    return steps.groupBy("series").agg(F.coalesce(F.median(inside), F.lit(10.0)).alias("ref_dt"))


def log_scale(rows: DataFrame) -> DataFrame:
    """log_mean, log_lo, log_hi of the positive values."""
    z = F.log("value")
    return rows.where(positive()).groupBy("series").agg(F.avg(z).alias("log_mean"), F.min(z).alias("log_lo"), F.max(z).alias("log_hi"), F.count("*").alias("n_obs"))


def kim(rows: DataFrame, q_scale: float = 0.1, r_scale: float = 3.0, var_ratio: float = 1.0) -> DataFrame:
    """Regime means (quartiles of the centred logs) and variances."""
    logs = rows.where(positive()).withColumn("value", F.log("value"))
    noise = mad_noise(logs, "b").select("series", F.greatest(F.col("sigma") * F.col("sigma"), F.lit(1e-4)).alias("base"))
    mu = logs.groupBy("series").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.avg("value").alias("m"))
    out = log_scale(rows).join(mu, "series").join(noise, "series").join(reference_step(rows), "series")
    return out.select(
        "series", "log_mean", "log_lo", "log_hi", (F.col("q")[0] - F.col("m")).alias("mu_0"), (F.col("q")[1] - F.col("m")).alias("mu_1"),
        (F.col("base") * q_scale).alias("q_0"), (F.col("base") * var_ratio * q_scale).alias("q_1"), (F.col("base") * r_scale).alias("r_0"), (F.col("base") * var_ratio * r_scale).alias("r_1"), "ref_dt",
    )


def dglm(rows: DataFrame, shape_scale: float = 1.0) -> DataFrame:
    """Shape of the gamma observations from their robust noise, prior level, and bounds."""
    rows = rows.where(positive())
    noise = mad_noise(rows, "b").select("series", F.greatest(F.col("sigma") * F.col("sigma"), F.lit(1e-6)).alias("noise"))
    out = rows.groupBy("series").agg(F.median("value").alias("med"), F.min("value").alias("lo"), F.max("value").alias("hi")).join(noise, "series")
    shape = F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("med") * F.col("med") / F.col("noise"))) * shape_scale
    return out.select("series", shape.alias("shape"), (-F.log("med")).alias("level"), "lo", "hi")


def recommend(log: DataFrame, allowed_n=(100, 250, 500, 1000), allowed_m=(25, 50, 100, 200)) -> DataFrame:
    """Cohort setting from successful tuning rows (n_star, m_star): the 90th percentile, raised to an allowed value."""
    pick = lambda p, allowed: F.coalesce(F.array_min(F.filter(F.array(*[F.lit(x) for x in allowed]), lambda x: x >= p)), F.lit(max(allowed)))
    p90 = log.where("status = 'success'").agg(F.floor(F.percentile("n_star", 0.9)).alias("n"), F.floor(F.percentile("m_star", 0.9)).alias("m"), F.count("*").alias("n_series"), F.count_if(~F.col("n_converged")).alias("n_unconverged"))
    return p90.select(pick(F.col("n"), allowed_n).alias("n_particles"), pick(F.col("m"), allowed_m).alias("n_paths"), "n_series", "n_unconverged")

"""Smoothers of whole tables: ``smooth(rows, method)``.

Readings are cut into chunks at gaps, each chunk is smoothed from a fresh state
with its series' calibration, chunks are spread over the cluster. Gates (chunk
length, value range) are plain filters before the grouped function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import filters
from tidemark.operators import calibrate
from tidemark.operators.describe import mad_noise
from tidemark.operators.gaps import chunks, gap_fill, islands
from tidemark.series import ordered, positive

LEAST_ROWS = 10
GP_PAIRS = 800


def observed_chunks(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Positive readings with chunk_id and ``t``, minutes from the chunk's start; chunks under ``least`` rows are left out."""
    cut = chunks(rows.where(positive()))
    whole = Window.partitionBy("series", "chunk_id")
    cut = cut.withColumn("__n", F.count("*").over(whole)).withColumn("t", (F.col("us") - F.min("us").over(whole)) / 60e6)
    return cut.where(F.col("__n") >= least).drop("__n")


def linear_calibration(rows: DataFrame, q_scale: float = 0.05, r_scale: float = 5.0) -> DataFrame:
    """log scale, f, q, r and ref_dt of the linear filter.

    The Gaussian process sees at most 800 pairs of consecutive readings of a
    series, chosen by hash; all pairs enter the residual variance.
    """
    cut = observed_chunks(rows).join(calibrate.log_scale(rows), "series").withColumn("z", F.log("value") - F.col("log_mean"))
    pairs = cut.withColumn("__prev", F.lag("z").over(ordered("series", "chunk_id"))).where("__prev IS NOT NULL").select("series", "row_id", F.col("__prev").alias("x"), F.col("z").alias("y"))
    pick = Window.partitionBy("series").orderBy(F.xxhash64("row_id"), "row_id")
    some = pairs.withColumn("__r", F.row_number().over(pick)).where(F.col("__r") <= GP_PAIRS)

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row_id")
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "f": [filters.gp_transition(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    kind = rows.schema["series"].dataType.simpleString()
    f = some.select("series", "row_id", "x", "y").groupBy("series").applyInPandas(learn, f"series {kind}, f double")
    noise = mad_noise(cut.withColumn("value", F.col("z")), "b").select("series", (F.greatest(F.col("sigma") * F.col("sigma"), F.lit(1e-4)) * r_scale).alias("r"))
    left = pairs.join(f, "series").groupBy("series", "f").agg(F.var_pop(F.col("y") - F.col("f") * F.col("x")).alias("v")).join(noise, "series")
    left = left.select("series", "f", (F.greatest(F.col("v") - F.col("r"), F.lit(1e-4)) * q_scale).alias("q"), "r")
    return left.join(calibrate.log_scale(rows), "series").join(calibrate.reference_step(rows), "series")


@dataclass(frozen=True)
class Smoother:
    """``calibrate``: rows to one row a series; ``run``: (t, values, parameters, seed) to output arrays named ``outputs``."""

    calibrate: Callable[[DataFrame], DataFrame]
    run: Callable
    outputs: tuple[str, ...] = ("smoothed",)
    causal: bool = True


def _logs(v, p):
    return np.log(v) - p["log_mean"]


def _level(z, p):
    return np.exp(np.clip(z + p["log_mean"], p["log_lo"], p["log_hi"]))


def _dglm(t, v, p, seed):
    return (filters.GammaModel(p["shape"], p["level"], p["lo"], p["hi"]).run(t, v)[0],)


def _dglm_offline(t, v, p, seed):
    model = filters.GammaModel(p["shape"], p["level"], p["lo"], p["hi"])
    model.run(t, v)
    return (model.look_back(),)


SMOOTHERS = {
    "rspf": Smoother(
        calibrate.rspf,
        lambda t, v, p, seed: filters.smooth_regimes(t, v, p["lo"], p["hi"], [p["mu_0"], p["mu_1"], p["mu_2"]], p["z_spread"], p["sigma_obs"], p["circ_amp"], seed),
        ("smoothed", "trend"),
    ),
    "krlst": Smoother(calibrate.log_scale, lambda t, v, p, seed: (_level(filters.smooth_krls(t, _logs(v, p)), p),)),
    "gpssm": Smoother(linear_calibration, lambda t, v, p, seed: (_level(filters.smooth_linear(t, _logs(v, p), p["f"], p["q"], p["r"], p["ref_dt"]), p),)),
    "ossa": Smoother(calibrate.log_scale, lambda t, v, p, seed: (_level(filters.smooth_ssa(_logs(v, p)), p),)),
    "kim": Smoother(calibrate.kim, lambda t, v, p, seed: (_level(filters.smooth_switching(t, _logs(v, p), [p["mu_0"], p["mu_1"]], [p["q_0"], p["q_1"]], [p["r_0"], p["r_1"]], p["ref_dt"]), p),)),
    "gammadglm": Smoother(calibrate.dglm, _dglm),
    "gammadglm_offline": Smoother(calibrate.dglm, _dglm_offline, causal=False),
}


def _seed(series, part, base: int) -> int:
    import zlib

    return zlib.crc32(f"{series}/{part}/{base}".encode())


def _grouped(parts: DataFrame, part: str, smoother: Smoother, base_seed: int) -> DataFrame:
    """Runs a smoother on each (series, part); calibration columns ride along with the rows."""
    names, own = smoother.outputs, {"series", "row_id", "ts", "us", "value", "t", part}
    params = [c for c in parts.columns if c not in own and dict(parts.dtypes)[c] in ("double", "bigint", "int")]
    key = parts.schema["series"].dataType.simpleString()
    row = parts.schema["row_id"].dataType.simpleString()

    def run(pdf):
        pdf = pdf.sort_values(["us", "row_id"])
        p = {c: float(pdf[c].iloc[0]) for c in params}
        outs = smoother.run(pdf["t"].to_numpy(float), pdf["value"].to_numpy(float), p, _seed(pdf["series"].iloc[0], pdf[part].iloc[0], base_seed))
        return pdf[["series", "row_id", "ts", "value", part]].assign(**dict(zip(names, outs, strict=True)))

    schema = f"series {key}, row_id {row}, ts timestamp_ntz, value double, {part} long, " + ", ".join(f"{n} double" for n in names)
    return parts.select("series", "row_id", "ts", "us", "value", "t", part, *params).groupBy("series", part).applyInPandas(run, schema)


def smooth(rows: DataFrame, method: str, seed: int = 0) -> DataFrame:
    """(series, row_id, ts, value, chunk_id, smoothed[, trend]) of the readings in chunks of ten rows or more."""
    smoother = SMOOTHERS[method]
    par = smoother.calibrate(rows).drop("n", "n_obs")
    return _grouped(observed_chunks(rows).select("series", "row_id", "ts", "us", "value", "t", "chunk_id").join(par, "series"), "chunk_id", smoother, seed)


def smooth_smc(rows: DataFrame, particles: int = 250, paths: int = 50, seed: int = 0) -> DataFrame:
    """Particle filter with backward simulation on every observed island of the grid; not causal.

    Columns: smoothed, trend, low, high (95 % band of the paths). Series with a
    range under 1, and islands under ten rows, are left out.
    """
    seg = islands(gap_fill(rows)).where("observed")
    whole = Window.partitionBy("series", "segment_id")
    seg = seg.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") >= LEAST_ROWS).withColumn("t", (F.col("us") - F.min("us").over(whole)) / 60e6)
    # Each island is calibrated as a series of its own, within its series' bounds.
    seg = seg.withColumn("island", F.concat_ws("/", F.col("series").cast("string"), "segment_id"))
    lim = calibrate.bounds(rows).select("series", "lo", "hi")
    own = seg.select(F.col("island").alias("series"), "ts", "row_id", "value", "us")
    marks = seg.join(lim, "series").select(F.col("island").alias("series"), F.explode(F.array("lo", "hi")).alias("value"))
    par = calibrate.smc(own, marks).withColumnRenamed("series", "island").withColumn("sigma_seas", F.lit(0.01))

    def run(t, v, p, s):
        return filters.smooth_smc(t, v, p, s, particles, paths)

    parts = seg.select("series", "row_id", "ts", "us", "value", "t", "segment_id", "island").join(par, "island").drop("island")
    return _grouped(parts, "segment_id", Smoother(calibrate.smc, run, ("smoothed", "trend", "low", "high"), False), seed)


def tune(rows: DataFrame, most: int = 500, least: int = 50) -> DataFrame:
    """(series, status, reason, n_star, m_star, n_converged, m_converged): particle and path numbers by each series' longest island."""
    from tidemark.operators.gaps import longest_segment

    grid = gap_fill(rows)
    seg = longest_segment(grid, most)
    par = calibrate.smc(seg, rows).withColumn("sigma_seas", F.lit(0.01))
    sized = seg.groupBy("series").agg(F.count("*").alias("n_used"))
    parts = seg.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("series"))) / 60e6)
    good = parts.join(sized.where(F.col("n_used") >= least), "series").join(par, "series")
    names = ["lo", "hi", "z_level_loc", "z_level_scale", "z_seas_scale", "sigma_obs", "sigma_level", "sigma_seas", "omega1", "omega2"]
    key = rows.schema["series"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["us", "row_id"])
        n, m, a, b = filters.tune_smc(pdf["t"].to_numpy(float), pdf["value"].to_numpy(float), {c: float(pdf[c].iloc[0]) for c in names})
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "n_star": [n], "m_star": [m], "n_converged": [a], "m_converged": [b]})

    # A number of partitions of its own, as small rows would be merged into one task although each series takes long.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = good.select("series", "row_id", "us", "t", "value", *names).repartition(tasks, "series").groupBy("series").applyInPandas(run, f"series {key}, n_star int, m_star int, n_converged boolean, m_converged boolean")
    log = sized.join(calibrate.bounds(rows).select("series", (F.col("hi") - F.col("lo")).alias("__range")), "series").join(found, "series", "left")
    reason = F.when(F.col("n_used") < least, f"Segment too short (<{least} rows)").when(F.col("__range") < 1, "observed range too narrow for bounded model")
    return log.select("series", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("reason"), "n_star", "m_star", "n_converged", "m_converged")


def smoothing_log(rows: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Status of each series: rows, smoothed rows, chunks, least smoothed value; a value of 0 or less fails the series."""
    total = rows.groupBy("series").agg(F.count("*").alias("n_rows"))
    got = smoothed.groupBy("series").agg(F.count("smoothed").alias("n_smoothed"), F.count_distinct("chunk_id").alias("n_chunks"), F.min("smoothed").alias("min_smoothed"))
    reason = F.when(F.col("n_smoothed").isNull(), "no chunk of 10 rows").when(F.col("min_smoothed") <= 0, "smoothed values not positive")
    log = total.join(got, "series", "left")
    return log.select("series", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("reason"), "n_rows", F.coalesce("n_smoothed", F.lit(0)).alias("n_smoothed"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "min_smoothed")


def forecast(rows: DataFrame, steps: int = 6, samples: int = 1000, seed: int = 0) -> DataFrame:
    """(series, step, mean, q05, q50, q95, loglik): gamma-model forecasts after each series' last chunk."""
    cut = observed_chunks(rows).withColumn("__last", F.max("chunk_id").over(Window.partitionBy("series"))).where("chunk_id = __last")
    parts = cut.join(calibrate.dglm(rows), "series")
    key = rows.schema["series"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["us", "row_id"])
        model = filters.GammaModel(*(float(pdf[c].iloc[0]) for c in ("shape", "level", "lo", "hi")))
        model.run(pdf["t"].to_numpy(float), pdf["value"].to_numpy(float))
        mean, q = model.forecast(steps, samples=samples, seed=seed)
        return pd.DataFrame({"series": [pdf["series"].iloc[0]] * steps, "step": range(1, steps + 1), "mean": mean, "q05": q[0], "q50": q[1], "q95": q[2], "loglik": model.loglik})

    return parts.select("series", "row_id", "us", "t", "value", "shape", "level", "lo", "hi").groupBy("series").applyInPandas(run, f"series {key}, step int, mean double, q05 double, q50 double, q95 double, loglik double")

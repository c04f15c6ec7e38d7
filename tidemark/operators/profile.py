"""Per-series profiles that need numerical kernels, and cohort verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spectra
from tidemark.operators import describe as D
from tidemark.operators.gaps import islands
from tidemark.series import observed


def _per_series(rows: DataFrame, run, fields: str) -> DataFrame:
    """``run`` maps a series' values in time order to a dict of ``fields``."""
    key = rows.schema["series"].dataType.simpleString()
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]

    def grouped(pdf):
        import pandas as pd

        found = run(pdf.sort_values(["us", "row_id"])["value"].to_numpy(float))
        return pd.DataFrame({"series": pdf["series"].iloc[:1], **{n: [found.get(n)] for n in names}})

    return rows.where(observed()).select("series", "us", "row_id", "value").groupBy("series").applyInPandas(grouped, f"series {key}, {fields}")


def kde_modes(rows: DataFrame) -> DataFrame:
    return _per_series(rows, lambda x: {"modes": spectra.kde_modes(x)}, "modes int")


def spectrum(rows: DataFrame, least: int = 200) -> DataFrame:
    """Spectral slope, fit, band shares and dominant period of the values with gaps closed; NULL up to ``least`` rows."""
    fields = "slope double, intercept double, r2 double, pct_circadian double, pct_semidiurnal double, dominant_hours double"
    return _per_series(rows, lambda x: spectra.spectrum(x) if len(x) > least else {}, fields)


def island_slope(rows: DataFrame, least: int = 50) -> DataFrame:
    """(series, slope): spectral slope of the longest observed island."""
    seg = islands(rows).where("observed")
    sizes = seg.groupBy("series", "segment_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy("series").agg(F.max_by("segment_id", F.struct("n", -F.col("segment_id"))).alias("segment_id"))
    return _per_series(seg.join(best, ["series", "segment_id"]), lambda x: spectra.spectrum(x, most=256) if len(x) > least else {}, "slope double")


def mixture(rows: DataFrame, least: int = 20) -> DataFrame:
    run = lambda x: spectra.gmm_delta_bic(x) if len(x) > least else {}
    return _per_series(rows, run, "delta_bic double, bimodal boolean, mode_gap double, means array<double>, weights array<double>")


def unit_root(rows: DataFrame, least: int = 50) -> DataFrame:
    out = _per_series(rows, lambda x: {"p_value": spectra.adf(x)} if len(x) > least and x.std() > 0 else {}, "p_value double")
    return out.withColumn("is_stationary", F.col("p_value") < 0.05)


def normality(rows: DataFrame, within: float = 15.0, most: int = 5000) -> DataFrame:
    """Shapiro-Wilk test of the first ``most`` differences within chunks."""
    d = D._differences(rows, within).select("series", "us", "row_id", F.col("__d").alias("value"))
    run = lambda x: dict(zip(("w", "p_value"), spectra.shapiro(x[:most]), strict=True)) if len(x) >= 12 else {}
    return _per_series(d, run, "w double, p_value double").withColumn("near_normal", F.col("p_value") > 0.05)


def raw_profile(grid: DataFrame) -> DataFrame:
    """One wide row a series of the gap-filled grid, with what the verdicts of raw data need."""
    values = D.value_stats(grid).where("var_ratio IS NOT NULL")
    wide = values.select("series", "n", "mean", "min", "max", "median", "std", F.col("kurtosis_excess").alias("kurt"), "var_ratio")
    return wide.join(D.circadian_amplitude(grid), "series").join(D.grid_stats(grid).select("series", "pct_on_grid_all", "null_pct"), "series")


def kernel_profile(rows: DataFrame, within: float = 15.0, most: int = 5000) -> DataFrame:
    """``spectrum``, ``mixture``, ``unit_root`` and ``normality`` of a series by one grouped call, with their limits."""
    key = rows.schema["series"].dataType.simpleString()
    fields = {
        "slope": "double", "intercept": "double", "r2": "double", "pct_circadian": "double", "pct_semidiurnal": "double", "dominant_hours": "double",
        "delta_bic": "double", "bimodal": "boolean", "mode_gap": "double", "means": "array<double>", "weights": "array<double>", "adf_p": "double", "shapiro_w": "double", "shapiro_p": "double",
    }

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["us", "row_id"])
        x, us = pdf["value"].to_numpy(float), pdf["us"].to_numpy()
        found = {}
        if len(x) > 200:
            found |= spectra.spectrum(x)
        if len(x) > 20:
            found |= spectra.gmm_delta_bic(x)
        if len(x) > 50 and x.std() > 0:
            found["adf_p"] = spectra.adf(x)
        d = np.diff(x)[np.diff(us) / 60e6 <= within]
        if len(d) >= 12:
            found["shapiro_w"], found["shapiro_p"] = spectra.shapiro(d[:most])
        return pd.DataFrame({"series": pdf["series"].iloc[:1], **{n: [found.get(n)] for n in fields}})

    schema = f"series {key}, " + ", ".join(f"{n} {t}" for n, t in fields.items())
    out = rows.where(observed()).select("series", "us", "row_id", "value").groupBy("series").applyInPandas(run, schema)
    return out.withColumn("is_stationary", F.col("adf_p") < 0.05).withColumn("near_normal", F.col("shapiro_p") > 0.05)


def wide_profile(grid: DataFrame) -> DataFrame:
    """All statistics of a series in one row: one pass over the grid, one over its values, one grouped call."""
    return D.value_stats(grid).drop("var_ratio").join(D.grid_stats(grid), "series").join(kernel_profile(grid), "series")


def _row(id_: str, trait: str, evidence: Column, verdict: Column) -> Column:
    return F.struct(F.lit(id_).alias("id"), F.lit(trait).alias("trait"), evidence.alias("evidence"), verdict.alias("verdict"))


def _pass(test: Column) -> Column:
    return F.when(test, "PASS").otherwise("FAIL")


def raw_verdicts(profile: DataFrame) -> DataFrame:
    """(id, trait, evidence double, verdict): the cohort's verdicts from ``raw_profile``; with its modes and slope columns, if given, two more."""
    med = lambda c: F.median(c).alias(c)
    aggs = [F.min("min").alias("min"), med("var_ratio"), med("amplitude"), med("kurt"), med("pct_on_grid_all"), med("null_pct"), F.avg(F.col("std") * F.col("std")).alias("within"), F.var_samp("median").alias("between")]
    more = [c for c in ("modes", "slope") if c in profile.columns]
    one = profile.agg(*aggs, *[med(c) for c in more])
    c = F.col
    rows = [
        _row("H1", "Bounded Positive", c("min"), _pass(c("min") > 0)),
        _row("H4", "Non-Stationary", c("var_ratio"), _pass(c("var_ratio") > 0.1)),
        _row("H5", "Circadian", c("amplitude"), _pass(c("amplitude") > 10)),
        _row("H6", "Heavy Tails", c("kurt"), _pass(c("kurt") > 1)),
        _row("H7", "Irregular Grid", c("pct_on_grid_all"), _pass(c("pct_on_grid_all") < 95)),
        _row("H8", "Missingness", c("null_pct"), _pass(c("null_pct") > 0)),
        _row("H10", "Between-Series Variance", c("between"), F.when(c("between") > c("within"), "HIGH (Must Normalize)").otherwise("LOW")),
    ]
    if "modes" in more:
        rows.append(_row("H2", "Bimodal", c("modes").cast("double"), _pass(c("modes") >= 2)))
    if "slope" in more:
        rows.append(_row("H3", "Long Memory", c("slope"), _pass(c("slope") < -0.5)))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def characteristic_verdicts(profile: DataFrame) -> DataFrame:
    """(id, evidence double, verdict) of the cohort from ``wide_profile``: the notebook's ten characteristics."""
    one = profile.agg(
        F.avg(F.col("all_positive").cast("double")).alias("pos"), F.avg((F.col("delta_bic") > 10).cast("double")).alias("bic"), F.median("slope").alias("slope"),
        F.avg((F.col("adf_p") >= 0.05).cast("double")).alias("ns"), F.median("pct_circadian").alias("circ"), F.median("diff_kurt").alias("dk"),
        F.median("pct_on_grid_steps").alias("grid"), F.median("null_pct").alias("nulls"), F.stddev_samp("mean").alias("sdm"),
    )
    c, one_of = F.col, lambda test, a, b: F.when(test, a).otherwise(b)
    rows = [
        ("H1", c("pos"), one_of(c("pos") == 1, "CONFIRMED", "MOSTLY")),
        ("H2", c("bic"), F.when(c("bic") > 0.5, "PRESENT").when(c("bic") > 0.2, "WEAK").otherwise("ABSENT")),
        ("H3", c("slope"), F.when(c("slope").between(-1.5, -0.5), "1/f-like").when(c("slope") < -1.5, "RW-like").otherwise("flatter-than-1/f")),
        ("H4", c("ns"), one_of(c("ns") > 0.5, "CONFIRMED", "MIXED")),
        ("H5", c("circ"), one_of(c("circ") >= 5, "PRESENT", "WEAK")),
        ("H6", c("dk"), one_of(c("dk") > 0.5, "HEAVY-TAILED", "near-Gaussian")),
        ("H7", c("grid"), one_of(c("grid") > 80, "REGULAR", "IRREGULAR")),
        ("H8", c("nulls"), F.lit("PRESENT")),
        ("H9", F.lit(None).cast("double"), F.lit("N/A")),
        ("H10", c("sdm"), one_of(c("sdm") > 5, "HIGH", "LOW")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), e.cast("double").alias("evidence"), v.alias("verdict")) for i, e, v in rows])).alias("r")).select("r.*")


def smoothed_verdicts(profile: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, evidence map<string,double>, verdict) after smoothing, from ``wide_profile`` of the smoothed and of the raw values.

    H4 to H8 and H10 compare the two: what stays within a quarter (shares within 20
    points) is preserved.
    """
    true_pct = lambda col: F.count_if(F.col(col)) / F.count("*") * 100
    was = raw.select("series", *[F.col(x).alias(f"raw_{x}") for x in ("is_stationary", "pct_circadian", "sigma_x", "pct_on_grid_steps", "null_pct", "mean")])
    one = profile.join(was, "series", "left").agg(
        true_pct("all_positive").alias("pos"), true_pct("is_bimodal").alias("bc"), true_pct("bimodal").alias("gmm"), F.median("mode_gap").alias("gap"), F.median("slope").alias("slope"),
        F.median("pct_circadian").alias("circ"), F.median("dominant_hours").alias("dom"), true_pct("is_stationary").alias("adf"), F.median("rolling_cv").alias("cv"), F.median("pct_semidiurnal").alias("semi"),
        F.median("diff_kurt").alias("dk"), true_pct("near_normal").alias("nn"), F.median("sigma_x").alias("sx"), F.median("median_step_min").alias("step"), F.median("pct_on_grid_steps").alias("grid"),
        F.median("null_pct").alias("nulls"), F.median("mean").alias("mean"), F.stddev_samp("mean").alias("sd_means"), F.stddev_samp("std").alias("sd_stds"), F.median("iqr").alias("iqr"),
        true_pct("raw_is_stationary").alias("raw_adf"), F.median("raw_pct_circadian").alias("raw_circ"), F.median("raw_sigma_x").alias("raw_sx"), F.median("raw_pct_on_grid_steps").alias("raw_grid"),
        F.median("raw_null_pct").alias("raw_nulls"), F.stddev_samp("raw_mean").alias("raw_sd_means"),
    )
    c = F.col
    share = lambda a, b: F.when(F.abs(c(a) - c(b)) <= 20, "PRESERVED").when(c(a) > c(b), "STRENGTHENED").otherwise("WEAKENED")
    ratio = lambda a, b, less, more: F.when(c(a) < 0.75 * c(b), less).when(c(a) <= 1.25 * c(b), "PRESERVED").otherwise(more)
    table = [
        ("H1", {"pct_all_positive": "pos"}, F.when(c("pos") == 100, "UNCHANGED").otherwise("VIOLATED")),
        ("H2", {"pct_bimodal_bc": "bc", "pct_bimodal_gmm": "gmm", "mode_gap": "gap"}, F.when(c("gmm") > 70, "PRESERVED").when(c("gmm") > 30, "WEAKENED").otherwise("RESOLVED")),
        ("H3", {"slope": "slope", "pct_circadian": "circ", "dominant_hours": "dom"}, F.when(c("slope") < -1.3, "STEEPENED").when(c("slope") <= -0.7, "ROUGHLY PRESERVED").otherwise("WHITENED")),
        ("H4", {"pct_stationary": "adf", "raw_pct_stationary": "raw_adf", "rolling_cv": "cv"}, share("adf", "raw_adf")),
        ("H5", {"pct_circadian": "circ", "raw_pct_circadian": "raw_circ", "pct_semidiurnal": "semi"}, ratio("circ", "raw_circ", "WEAKENED", "STRENGTHENED")),
        ("H6", {"diff_kurt": "dk", "pct_near_normal": "nn", "sigma_x": "sx", "raw_sigma_x": "raw_sx"}, F.when(c("sx") < 0.5 * c("raw_sx"), "SUBSTANTIALLY REDUCED").when(c("sx") < 0.9 * c("raw_sx"), "REDUCED").otherwise("UNCHANGED")),
        ("H7", {"median_step": "step", "pct_on_grid": "grid", "raw_pct_on_grid": "raw_grid"}, F.when(c("grid") >= 95, "RESOLVED").otherwise(share("grid", "raw_grid"))),
        ("H8", {"null_pct": "nulls", "raw_null_pct": "raw_nulls"}, F.when(c("nulls") == 0, "RESOLVED").when(c("nulls") == c("raw_nulls"), "UNCHANGED").otherwise("TRANSFORMED")),
        ("H9", {}, F.lit("UNCHANGED")),
        ("H10", {"mean": "mean", "sd_of_means": "sd_means", "raw_sd_of_means": "raw_sd_means", "sd_of_stds": "sd_stds", "iqr": "iqr"}, ratio("sd_means", "raw_sd_means", "REDUCED", "INFLATED")),
    ]
    cell = lambda ev: F.create_map(*[x for k, v in ev.items() for x in (F.lit(k), c(v).cast("double"))]) if ev else F.create_map().cast("map<string,double>")
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), cell(ev).alias("evidence"), v.alias("verdict")) for i, ev, v in table])).alias("r")).select("r.*")

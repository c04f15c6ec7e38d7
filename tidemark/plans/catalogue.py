"""Catalogue of queries: name to plan, and name to equivalent SQL.

All queries run over the whole events table. Series keys: each user, each of ten
groups of users, or each event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calibrate, describe, detect, gaps, profile, smooth
from tidemark.series import SeriesSpec

USER, GROUP, KIND = SeriesSpec("user_id"), SeriesSpec("user_id % 10"), SeriesSpec("event_type")
DIGITS = 6


def _rows(spark: SparkSession, sf_dir: str, spec: SeriesSpec) -> DataFrame:
    return spec.normalise(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of additions doesn't show."""
    return df.withColumns({c: F.round(c, DIGITS) for c, kind in df.dtypes if kind == "double"})


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(spec: SeriesSpec, name: str | None = None, sql: str | None = None):
    """Registers a function of normalised rows; ``sql`` sees them as the CTE ``s`` (series, ts, us, row_id, v)."""

    def add(f):
        own = name or f.__name__
        _QUERIES[own] = lambda spark, sf_dir: _rounded(f(_rows(spark, sf_dir, spec)))
        if sql:
            _SQL[own] = f"WITH RECURSIVE s AS (SELECT {spec.key} AS series, ts, epoch_us(ts) AS us, event_id AS row_id, value AS v FROM events)" + sql
        return f

    return add


_W = "(PARTITION BY series ORDER BY us, row_id)"
_STEPS = f", st AS (SELECT *, (us - lag(us) OVER {_W}) / 6e7 AS dt FROM s)"
_CHUNKS = _STEPS + ", ch AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt >= 180 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY us, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk_id FROM st)"
_GRID = f"""{_STEPS}, nx AS (SELECT *, lead(ts) OVER {_W} AS nts FROM s),
fill AS (SELECT series, unnest(range(ts + INTERVAL 10 MINUTE, nts, INTERVAL 10 MINUTE)) AS ts, NULL::BIGINT AS row_id, NULL::DOUBLE AS v FROM nx WHERE epoch_us(nts) - epoch_us(ts) > 10800000000),
g0 AS (SELECT series, ts, row_id, v FROM s UNION ALL SELECT * FROM fill),
g1 AS (SELECT *, epoch_us(ts) AS us FROM g0),
g AS (SELECT *, (us - lag(us) OVER {_W}) / 6e7 AS dt, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS gap_flag FROM g1)"""
_ISLANDS = _GRID + f""", i0 AS (SELECT *, CASE WHEN lag(gap_flag) OVER {_W} IS DISTINCT FROM gap_flag THEN 1 ELSE 0 END AS turn FROM g),
isl AS (SELECT *, sum(turn) OVER (PARTITION BY series ORDER BY us, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM i0)"""
_DIFFS = f", d AS (SELECT series, us, row_id, dt, v - lag(v) OVER {_W} AS d FROM st)"


def _r(x: str, name: str) -> str:
    return f"round({x}, {DIGITS}) AS {name}"


# -- grid, chunks, islands -----------------------------------------------------


@_query(USER, sql=_GRID + f" SELECT series, ts, row_id, {_r('v', 'value')}, {_r('dt', 'minute_diff')}, gap_flag FROM g")
def gap_fill(rows):
    return gaps.gap_fill(rows).drop("us")


@_query(USER, sql=_GRID + f" SELECT series, count(*) AS n_rows, sum(gap_flag)::BIGINT AS n_filled, {_r('max(dt)', 'max_step')}, {_r('avg(v)', 'mean_value')} FROM g GROUP BY series")
def gap_fill_summary(rows):
    return gaps.gap_fill(rows).groupBy("series").agg(F.count("*").alias("n_rows"), F.sum("gap_flag").alias("n_filled"), F.max("minute_diff").alias("max_step"), F.avg("value").alias("mean_value"))


@_query(USER, sql=_CHUNKS + f" SELECT series, ts, row_id, {_r('v', 'value')}, {_r('dt', 'time_diff_min')}, dt IS NULL OR dt >= 180 AS gap_boundary, chunk_id FROM ch")
def chunk_assign(rows):
    return gaps.chunks(rows).drop("us")


@_query(GROUP, sql=_CHUNKS + f" SELECT series, chunk_id, count(*) AS n, min(ts) AS chunk_start, max(ts) AS chunk_end, {_r('avg(v)', 'mean_value')} FROM ch GROUP BY ALL")
def chunk_summary(rows):
    return gaps.chunks(rows).groupBy("series", "chunk_id").agg(F.count("*").alias("n"), F.min("ts").alias("chunk_start"), F.max("ts").alias("chunk_end"), F.avg("value").alias("mean_value"))


@_query(GROUP, sql=_ISLANDS + " SELECT series, segment_id, gap_flag = 0 AS observed, count(*) AS n_rows, min(ts) AS first_ts FROM isl GROUP BY ALL")
def islands_segments(rows):
    return gaps.islands(gaps.gap_fill(rows)).groupBy("series", "segment_id", "observed").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"))


@_query(
    GROUP,
    sql=_ISLANDS
    + f""", z AS (SELECT series, segment_id, count(*) AS n FROM isl WHERE gap_flag = 0 GROUP BY ALL),
b AS (SELECT series, segment_id FROM z QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, segment_id) = 1)
SELECT series, ts, row_id, {_r("v", "value")}, segment_id FROM isl JOIN b USING (series, segment_id) QUALIFY row_number() OVER {_W} <= 500""",
)
def longest_segment(rows):
    return gaps.longest_segment(gaps.gap_fill(rows), 500).select("series", "ts", "row_id", "value", "segment_id")


@_query(GROUP, sql=_CHUNKS + _GRID.replace(_STEPS, "") + f" SELECT g.series, g.ts, g.row_id, {_r('g.v', 'value')}, gap_flag, {_r('ch.v', 'merged')} FROM g LEFT JOIN ch ON g.series = ch.series AND g.row_id = ch.row_id")
def merge_back(rows):
    return gaps.merge_back(gaps.gap_fill(rows), gaps.chunks(rows).withColumn("merged", F.col("value")), "merged").select("series", "ts", "row_id", "value", "gap_flag", "merged")


@_query(USER, sql=_STEPS + f", m AS (SELECT series, lag(ts) OVER {_W} AS gap_start, ts AS gap_end, dt FROM st) SELECT series, gap_start, gap_end, {_r('dt', 'gap_minutes')} FROM m WHERE dt > 180")
def gap_markers(rows):
    return gaps.gap_markers(rows)


# -- descriptions -----------------------------------------------------------------

_DESCRIBE = f""" SELECT series, count(*) AS n, {_r("avg(v)", "mean")}, {_r("stddev_pop(v)", "std")}, {_r("min(v)", "min")}, {_r("max(v)", "max")},
{_r("avg(power((v - m) / sd, 3))", "skew")}, {_r("kurtosis_pop(v)", "kurtosis_excess")}, bool_and(v > 0) AS all_positive, count(*) FILTER (v <= 0) AS n_nonpositive, count(*) FILTER (v > 300) AS n_above_300,
{_r("quantile_cont(v, 0.05)", "q05")}, {_r("quantile_cont(v, 0.25)", "q25")}, {_r("median(v)", "median")}, {_r("quantile_cont(v, 0.75)", "q75")}, {_r("quantile_cont(v, 0.95)", "q95")},
{_r("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "iqr")}, {_r("quantile_cont(v, 0.95) - quantile_cont(v, 0.05)", "range_90")}
FROM (SELECT *, avg(v) OVER (PARTITION BY series) AS m, stddev_pop(v) OVER (PARTITION BY series) AS sd FROM s) GROUP BY series"""


@_query(KIND, sql=_DESCRIBE)
def series_describe(rows):
    return describe.describe(rows)


@_query(USER, sql=_DESCRIBE)
def series_describe_users(rows):
    return describe.describe(rows)


@_query(GROUP, sql=_GRID + f" SELECT series, count(*) AS n_rows, {_r('avg(gap_flag) * 100', 'null_pct')} FROM g GROUP BY series")
def null_rate(rows):
    return describe.null_rate(gaps.gap_fill(rows))


_MAD = {
    "a": f"SELECT series, {_r('greatest(1.4826 * median(abs(d)) / sqrt(2.0), 1.0)', 'sigma')} FROM d GROUP BY series",
    "b": f"SELECT series, {_r('1.4826 * mad(d) / sqrt(2.0)', 'sigma')} FROM d GROUP BY series",
    "c": f"SELECT series, {_r('median(abs(d)) / 0.6745', 'sigma')} FROM d GROUP BY series",
    "k": f"SELECT series, {_r('1.4826 * mad(d)', 'sigma')} FROM d GROUP BY series",
}
for _v, _sql in _MAD.items():
    _query(GROUP, f"mad_noise_{_v}", _STEPS + _DIFFS + " " + _sql)(lambda rows, v=_v: describe.mad_noise(rows, v))


@_query(
    KIND,
    sql=_STEPS
    + _DIFFS
    + f""", w AS (SELECT *, avg(d) OVER (PARTITION BY series) AS m, stddev_pop(d) OVER (PARTITION BY series) AS sd FROM d WHERE d IS NOT NULL AND dt <= 15)
SELECT series, count(*) AS n_diffs, {_r("1.4826 * median(abs(d)) / sqrt(2.0)", "sigma_x")}, {_r("stddev_pop(d)", "diff_std")}, {_r("kurtosis_pop(d)", "diff_kurt")}, {_r("avg(power((d - m) / sd, 3))", "diff_skew")} FROM w GROUP BY series""",
)
def within_diff_stats(rows):
    return describe.within_diff_stats(rows)


@_query(GROUP, sql=f" SELECT series, hour(ts)::INTEGER AS hour, {_r('median(v)', 'median_value')} FROM s GROUP BY ALL")
def hour_profile(rows):
    return describe.hour_profile(rows)


@_query(GROUP, sql=f", h AS (SELECT series, hour(ts) AS h, median(v) AS m FROM s GROUP BY ALL) SELECT series, {_r('max(m) - min(m)', 'amplitude')} FROM h GROUP BY series")
def circadian_amplitude(rows):
    return describe.circadian_amplitude(rows)


@_query(
    GROUP,
    sql=_GRID
    + f""" SELECT series, {_r("median(dt)", "median_step_min")}, {_r("stddev_samp(dt)", "std_step_min")}, {_r("avg(CASE WHEN abs(dt - 10) < 0.5 THEN 1.0 ELSE 0.0 END) * 100", "pct_on_grid_all")},
{_r("avg((abs(dt - 10) < 0.5)::INT) * 100", "pct_on_grid_steps")} FROM g GROUP BY series""",
)
def step_stats(rows):
    return describe.step_stats(gaps.gap_fill(rows))


_BIMODAL = f""", m AS (SELECT *, avg(v) OVER (PARTITION BY series) AS m, stddev_pop(v) OVER (PARTITION BY series) AS sd FROM s),
k AS (SELECT series, count(*) AS n, avg(power((v - m) / sd, 3)) AS sk, kurtosis_pop(v) AS ku FROM m GROUP BY series),
b AS (SELECT series, (sk * sk + 1) / (ku + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) + EXTRA) AS x FROM k WHERE n > 3)
SELECT series, {_r("x", "bimodality")}, x > 0.555 AS is_bimodal FROM b"""
_query(KIND, "bimodality", _BIMODAL.replace("EXTRA", "3"))(describe.bimodality)
_query(KIND, "bimodality_corrected", _BIMODAL.replace("EXTRA", "0"))(lambda rows: describe.bimodality(rows, corrected=True))


@_query(
    KIND,
    sql=f""", r AS (SELECT series, v, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS m FROM s WINDOW w AS (PARTITION BY series ORDER BY us, row_id ROWS 23 PRECEDING))
SELECT series, {_r("CASE WHEN var_pop(v) > 0 THEN var_samp(m) / var_pop(v) ELSE 0.0 END", "var_ratio")} FROM r GROUP BY series HAVING count(*) >= 24""",
)
def rolling_mean24_varratio(rows):
    return describe.rolling_mean_ratio(rows)


@_query(
    KIND,
    sql=f""", r AS (SELECT series, CASE WHEN count(v) OVER w > 1 THEN stddev_samp(v) OVER w END AS sd FROM s WINDOW w AS (PARTITION BY series ORDER BY us, row_id ROWS 143 PRECEDING))
SELECT series, {_r("stddev_samp(sd) / avg(sd)", "rolling_cv")} FROM r GROUP BY series HAVING avg(sd) > 0""",
)
def rolling_std144_cv(rows):
    return describe.rolling_std_cv(rows)


@_query(
    GROUP,
    sql=_GRID
    + f""" SELECT series, ts, row_id, gap_flag, {_r("coalesce(CASE WHEN count(v) OVER w >= 36 THEN avg(v) OVER w END, avg(v) OVER x)", "trend")} FROM g
WINDOW w AS (PARTITION BY series ORDER BY us, row_id ROWS BETWEEN 72 PRECEDING AND 71 FOLLOWING), x AS (PARTITION BY series ORDER BY us, row_id ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING)""",
)
def centred_ma_backfill(rows):
    return describe.centred_mean(gaps.gap_fill(rows)).select("series", "ts", "row_id", "gap_flag", "trend")


@_query(
    GROUP,
    sql=_GRID
    + f""" SELECT series, ts, row_id, {_r("CASE WHEN count(v) OVER w >= 36 THEN avg(v) OVER w END", "band_mean")}, {_r("CASE WHEN count(v) OVER w >= 36 THEN stddev_samp(v) OVER w END", "band_std")} FROM g
WINDOW w AS (PARTITION BY series ORDER BY us, row_id ROWS BETWEEN 72 PRECEDING AND 71 FOLLOWING)""",
)
def rolling_bands(rows):
    return describe.rolling_band(gaps.gap_fill(rows)).select("series", "ts", "row_id", "band_mean", "band_std")


@_query(KIND, sql=f" SELECT series, row_id, {_r('v', 'value')}, {_r('(row_number() OVER (PARTITION BY series ORDER BY v, us, row_id) - 0.5) / count(*) OVER (PARTITION BY series)', 'share')} FROM s")
def normal_scores(rows):
    return describe.normal_scores(rows)


@_query(USER, sql=_CHUNKS + ", n AS (SELECT series, chunk_id, count(*) AS n FROM ch GROUP BY ALL) SELECT CASE WHEN n >= 10 THEN 'success' ELSE 'failed' END AS status, count(*) AS n_chunks FROM n GROUP BY ALL")
def chunk_status_counts(rows):
    """How many chunks are long enough to be smoothed."""
    sizes = gaps.chunks(rows).groupBy("series", "chunk_id").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") >= smooth.LEAST_ROWS, "success").otherwise("failed").alias("status")).agg(F.count("*").alias("n_chunks"))


@_query(GROUP, sql=_GRID + f" SELECT series, ts, row_id, gap_flag, {_r('CASE WHEN gap_flag = 0 THEN avg(v) OVER x END', 'trend')} FROM g WINDOW x AS (PARTITION BY series ORDER BY us, row_id ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING)")
def blank_gap_trend(rows):
    """A short centred mean, blank in gaps."""
    grid = describe.centred_mean(gaps.gap_fill(rows), 36, 1, 36)
    return gaps.blank_gaps(grid, ["trend"]).select("series", "ts", "row_id", "gap_flag", "trend")


@_query(
    USER,
    sql=""", c AS (SELECT *, count(*) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT series, ts - INTERVAL 3 DAY AS window_start, ts AS window_end, n FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, us, row_id) = 1""",
)
def densest_3day(rows):
    return describe.densest_window(rows)


@_query(
    KIND,
    sql=f""", x AS (SELECT *, v - avg(v) OVER (PARTITION BY series) AS x FROM s),
p AS (SELECT series, x * x AS xx, {", ".join(f"x * lag(x, {k}) OVER {_W} AS p{k}" for k in (1, 6, 144, 288))} FROM x)
SELECT series, count(*) AS n, {_r("1.96 / sqrt(count(*))", "acf_bound")}, {", ".join(_r(f"sum(p{k}) / sum(xx)", f"acf_{k}") for k in (1, 6, 144, 288))} FROM p GROUP BY series""",
)
def acf_lags(rows):
    return describe.autocorrelation(rows)


@_query(
    KIND,
    sql=""", e AS (SELECT *, min(v) OVER (PARTITION BY series) AS lo, max(v) OVER (PARTITION BY series) AS hi FROM s)
SELECT series, bin, n, round(lo + bin * (hi - lo) / 60, 6) AS bin_low, round(lo + (bin + 1) * (hi - lo) / 60, 6) AS bin_high FROM (
  SELECT series, (CASE WHEN hi > lo THEN least(59, floor((v - lo) / (hi - lo) * 60)) ELSE 0 END)::INTEGER AS bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi FROM e GROUP BY 1, 2) b""",
)
def value_histogram(rows):
    return describe.histogram(rows)


@_query(USER, sql=f", m AS (SELECT series, avg(v) AS m FROM s GROUP BY series) SELECT series, {_r('m', 'mean')} FROM m ORDER BY m DESC, series LIMIT 10")
def top_series_by_mean(rows):
    return describe.describe(rows).select("series", "mean").orderBy(F.col("mean").desc(), "series").limit(10)


# -- calibration ------------------------------------------------------------------

_Z = ", b AS (SELECT series, min(v) AS lo, max(v) AS hi, count(*) AS n FROM s WHERE v > 0 GROUP BY series HAVING max(v) > min(v)), z AS (SELECT s.*, ln(u / (1 - u)) AS z FROM (SELECT s.*, greatest(1e-4, least(1 - 1e-4, (v - lo) / (hi - lo))) AS u FROM s JOIN b USING (series) WHERE v > 0) s)"
_POSD = f", pd AS (SELECT series, v - lag(v) OVER {_W} AS d FROM s WHERE v > 0)"


@_query(
    GROUP,
    sql=_Z
    + _POSD
    + f""", zz AS (SELECT series, quantile_cont(z, 0.5 / 3) AS a, quantile_cont(z, 0.5) AS c, quantile_cont(z, 2.5 / 3) AS e, greatest(1.4826 * mad(z), 0.2) AS sp FROM z GROUP BY series),
nn AS (SELECT series, greatest(1.4826 * mad(d) / sqrt(2.0), 1.0) AS sg FROM pd GROUP BY series)
SELECT series, {_r("lo", "lo")}, {_r("hi", "hi")}, {_r("a", "mu_0")}, {_r("c", "mu_1")}, {_r("e", "mu_2")}, {_r("sp", "z_spread")}, {_r("sg", "sigma_obs")}, {_r("c", "level_loc")}, {_r("0.4 * sp", "circ_amp")}
FROM b JOIN zz USING (series) JOIN nn USING (series)""",
)
def calibrate_rspf(rows):
    return calibrate.rspf(rows)


@_query(
    GROUP,
    sql=_STEPS
    + f""", l AS (SELECT *, ln(v) AS z FROM s WHERE v > 0), ld AS (SELECT series, z - lag(z) OVER {_W} AS d FROM l),
q AS (SELECT series, avg(z) AS m, min(z) AS lo, max(z) AS hi, quantile_cont(z, 0.25) AS q0, quantile_cont(z, 0.75) AS q1 FROM l GROUP BY series),
n AS (SELECT series, greatest(power(1.4826 * mad(d) / sqrt(2.0), 2), 1e-4) AS r FROM ld GROUP BY series),
x AS (SELECT series, coalesce(median(dt) FILTER (dt > 0 AND dt < 180), 10.0) AS ref FROM st GROUP BY series)
SELECT series, {_r("m", "log_mean")}, {_r("lo", "log_lo")}, {_r("hi", "log_hi")}, {_r("q0 - m", "mu_0")}, {_r("q1 - m", "mu_1")}, {_r("r * 0.1", "q_0")}, {_r("r * 0.1", "q_1")}, {_r("r * 3", "r_0")}, {_r("r * 3", "r_1")}, {_r("ref", "ref_dt")}
FROM q JOIN n USING (series) JOIN x USING (series)""",
)
def calibrate_kim(rows):
    return calibrate.kim(rows)


@_query(
    GROUP,
    sql=_POSD
    + f""", n AS (SELECT series, greatest(power(1.4826 * mad(d) / sqrt(2.0), 2), 1e-6) AS r FROM pd GROUP BY series), m AS (SELECT series, median(v) AS m, min(v) AS lo, max(v) AS hi FROM s WHERE v > 0 GROUP BY series)
SELECT series, {_r("greatest(1.0, least(1e4, m * m / r))", "shape")}, {_r("-ln(m)", "level")}, {_r("lo", "lo")}, {_r("hi", "hi")} FROM m JOIN n USING (series)""",
)
def calibrate_dglm(rows):
    return calibrate.dglm(rows)


@_query(
    KIND,
    sql=_STEPS
    + _DIFFS
    + f""", b AS (SELECT series, min(v) AS lo, max(v) AS hi FROM s GROUP BY series HAVING max(v) - min(v) >= 1),
sd AS (SELECT series, coalesce(median(dt) FILTER (dt > 0), 10.0) AS md FROM st GROUP BY series),
z AS (SELECT series, i, md, lo, hi, ln(u / (1 - u)) AS z FROM (SELECT s.series, lo, hi, md, row_number() OVER (PARTITION BY s.series ORDER BY us, row_id) AS i, greatest(1e-6, least(1 - 1e-6, (v - lo) / (hi - lo))) AS u FROM s JOIN b USING (series) JOIN sd USING (series)) q),
k AS (SELECT series, lo, hi, md, median(z) FILTER (i <= greatest(floor(1440 / md), 50)) AS loc, greatest(1.4826 * mad(z), 0.2) AS sp FROM z GROUP BY ALL),
n AS (SELECT series, greatest(1.4826 * median(abs(d)) / sqrt(2.0), 1.0) AS sg FROM d GROUP BY series)
SELECT series, {_r("lo", "lo")}, {_r("hi", "hi")}, {_r("loc", "z_level_loc")}, {_r("sp / 2", "z_level_scale")}, {_r("sp", "z_seas_scale")}, {_r("sg", "sigma_obs")}, {_r("0.02 * sp", "sigma_level")},
{_r("2 * pi() * md / 1440", "omega1")}, {_r("4 * pi() * md / 1440", "omega2")} FROM k JOIN n USING (series)""",
)
def calibrate_smc(rows):
    return calibrate.smc(rows, rows)


@_query(
    USER,
    sql=""", l AS (SELECT CASE WHEN count(v) < 10 THEN 'failed' ELSE 'success' END AS status, CASE WHEN count(v) < 55 THEN 100 WHEN count(v) < 70 THEN 250 WHEN count(v) < 85 THEN 500 ELSE 1000 END AS n,
  CASE WHEN stddev_pop(v) < avg(v) * 0.9 THEN 25 WHEN stddev_pop(v) < avg(v) THEN 50 WHEN stddev_pop(v) < avg(v) * 1.1 THEN 100 ELSE 200 END AS m, count(v) < 80 AS c FROM s GROUP BY series),
p AS (SELECT floor(quantile_cont(n, 0.9)) AS n, floor(quantile_cont(m, 0.9)) AS m, count(*) AS n_series, count(*) FILTER (NOT c) AS n_unconverged FROM l WHERE status = 'success')
SELECT (CASE WHEN n <= 100 THEN 100 WHEN n <= 250 THEN 250 WHEN n <= 500 THEN 500 ELSE 1000 END)::INTEGER AS n_particles,
  (CASE WHEN m <= 25 THEN 25 WHEN m <= 50 THEN 50 WHEN m <= 100 THEN 100 ELSE 200 END)::INTEGER AS n_paths, n_series, n_unconverged FROM p""",
)
def tuning_recommendation(rows):
    """A cohort's setting from a log of series; sizes by number and spread of readings stand for the tuning's own."""
    n, cv = F.col("n"), F.col("std") / F.col("mean")
    log = describe.describe(rows).select(
        F.when(n < 10, "failed").otherwise("success").alias("status"),
        F.when(n < 55, 100).when(n < 70, 250).when(n < 85, 500).otherwise(1000).alias("n_star"),
        F.when(cv < 0.9, 25).when(cv < 1, 50).when(cv < 1.1, 100).otherwise(200).alias("m_star"),
        (n < 80).alias("n_converged"),
    )
    return calibrate.recommend(log)


# -- change points ----------------------------------------------------------------

_SEG = _CHUNKS + ", q AS (SELECT *, row_number() OVER (PARTITION BY series, chunk_id ORDER BY us, row_id) AS i FROM ch)"
_KALMAN = (
    _SEG
    + """, rec AS (
SELECT series, chunk_id, i, ts, row_id, us, v, v AS x, 0.0::DOUBLE AS w, 10.0 - 100.0 / 20.0 AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c, 0.0::DOUBLE AS score FROM q WHERE i = 1
UNION ALL
SELECT series, chunk_id, i, ts, row_id, us, v, xp + ap / (ap + 10) * (v - xp), w + bp / (ap + 10) * (v - xp), ap - ap * ap / (ap + 10), bp - ap * bp / (ap + 10), cp - bp * bp / (ap + 10), (v - xp) * (v - xp) / (ap + 10) FROM (
  SELECT n.series, n.chunk_id, n.i, n.ts, n.row_id, n.us, n.v, r.x + r.w * n.dt AS xp, r.w, r.a + 2 * n.dt * r.b + n.dt * n.dt * r.c + 0.1 * power(n.dt, 4) / 4 AS ap, r.b + n.dt * r.c + 0.1 * power(n.dt, 3) / 2 AS bp, r.c + 0.1 * n.dt * n.dt AS cp
  FROM rec r JOIN q n ON n.series = r.series AND n.chunk_id = r.chunk_id AND n.i = r.i + 1) p)"""
)


@_query(GROUP, sql=_KALMAN + f" SELECT series, ts, row_id, {_r('v', 'value')}, chunk_id, CASE WHEN score > 60 THEN 'adverse' WHEN score > 8 THEN 'medium' ELSE 'normal' END AS kalman_type, {_r('least(score / 60, 1)', 'kalman_degree')} FROM rec")
def cpd_kalman(rows):
    return detect.detect(rows, "kalman")


@_query(
    GROUP,
    sql=_SEG
    + f""", n AS (SELECT series, chunk_id, count(*) AS n FROM q GROUP BY ALL)
SELECT series, ts, row_id, {_r("v", "value")}, chunk_id, 'normal' AS bocpd_type, {_r("CASE WHEN n < 2 THEN 0 ELSE 1.0::DOUBLE / 150 END", "bocpd_degree")} FROM q JOIN n USING (series, chunk_id)""",
)
def cpd_bocpd(rows):
    return detect.detect(rows, "bocpd")


@_query(GROUP, sql=_KALMAN + f" SELECT series, 'kalman' AS method, ts, {_r('least(score / 60, 1)', 'degree')} FROM rec WHERE score > 60")
def cpd_alarm_markers(rows):
    return detect.markers(detect.detect(rows, "kalman"), ["kalman"], alarms=True)


@_query(GROUP, sql=_KALMAN + " SELECT DISTINCT series, ts FROM rec WHERE score > 60")
def cpd_markers_union(rows):
    return detect.marker_union(detect.markers(detect.detect(rows, "kalman"), ["kalman"], alarms=True))


for _m in ("kcp", "hmm", "bocpd_run_length"):
    _query(GROUP, f"cpd_{_m}")(lambda rows, m=_m: detect.detect(rows, m))
_query(GROUP, "annotation_log")(lambda rows: detect.annotation_log(detect.detect(rows), rows=rows))
_query(
    GROUP,
    "annotation_log_kalman",
    _KALMAN + " SELECT series, 'success' AS status, NULL::VARCHAR AS reason, count(*) AS n_rows, 0::BIGINT AS n_bocpd, count(*) FILTER (score > 8) AS n_kalman FROM rec GROUP BY series",
)(lambda rows: detect.annotation_log(detect.detect(rows, ["bocpd", "kalman"]), ["bocpd", "kalman"], rows))
_query(GROUP, "annotate_kim")(lambda rows: detect.annotate(smooth.smooth(rows, "kim")))

# -- smoothers --------------------------------------------------------------------

_BIG = ", n AS (SELECT series, chunk_id, count(*) AS n FROM q GROUP BY ALL HAVING count(*) >= 10)"
_POSITIVE = _SEG.replace("FROM s)", "FROM s WHERE v > 0)", 1) + _BIG
_LINEAR = (
    _POSITIVE
    + f""", sc AS (SELECT series, avg(ln(v)) AS m, min(ln(v)) AS lo, max(ln(v)) AS hi FROM s WHERE v > 0 GROUP BY series),
k AS (SELECT q.*, ln(v) - m AS z, m, lo, hi FROM q JOIN n USING (series, chunk_id) JOIN sc USING (series)),
rec AS (
SELECT series, chunk_id, i, ts, row_id, v, m, lo, hi, z AS x, 0.55::DOUBLE AS p FROM k WHERE i = 1
UNION ALL
SELECT series, chunk_id, i, ts, row_id, v, m, lo, hi, xp + pp / (pp + 0.5) * (z - xp), (1 - pp / (pp + 0.5)) * pp FROM (
  SELECT n.series, n.chunk_id, n.i, n.ts, n.row_id, n.v, n.m, n.lo, n.hi, n.z, 0.9 * r.x AS xp, 0.81 * r.p + 0.05 * greatest(n.dt / 10, 1e-6) AS pp
  FROM rec r JOIN k n ON n.series = r.series AND n.chunk_id = r.chunk_id AND n.i = r.i + 1) j)
SELECT series, row_id, ts, {_r("v", "value")}, chunk_id, {_r("exp(greatest(lo, least(hi, x + m)))", "smoothed")} FROM rec"""
)


@_query(GROUP, sql=_LINEAR)
def smooth_gpssm_filter(rows):
    """The linear filter with f, q, r given."""
    par = lambda r: calibrate.log_scale(r).withColumns({"f": F.lit(0.9), "q": F.lit(0.05), "r": F.lit(0.5), "ref_dt": F.lit(10.0)})
    given = smooth.Smoother(par, smooth.SMOOTHERS["gpssm"].run)
    parts = smooth.observed_chunks(rows).select("series", "row_id", "ts", "us", "value", "t", "chunk_id")
    return smooth._grouped(parts.join(par(rows).drop("n_obs"), "series"), "chunk_id", given, 0)


def _kim_sql() -> str:
    """The two-regime recursion: four branches a step, joint weights, moment matching."""
    pairs = [(i, j) for i in (0, 1) for j in (0, 1)]
    ahead = ", ".join(f"mu{j} + keep * (m{i} - mu{j}) AS h{i}{j}, keep * keep * v{i} + q{j} * sc AS s{i}{j}" for i, j in pairs)
    gain = ", ".join(f"s{i}{j} / (s{i}{j} + r{j}) AS g{i}{j}, z - h{i}{j} AS e{i}{j}" for i, j in pairs)
    branch = ", ".join(
        f"h{i}{j} + g{i}{j} * e{i}{j} AS b{i}{j}, (1 - g{i}{j}) * s{i}{j} AS c{i}{j}, p{i} * {0.95 if i == j else 0.05} * exp(-0.5 * e{i}{j} * e{i}{j} / (s{i}{j} + r{j})) / sqrt(2 * pi() * (s{i}{j} + r{j})) AS w{i}{j}" for i, j in pairs
    )
    total = "(w00 + w01 + w10 + w11)"
    joint = ", ".join(f"CASE WHEN {total} > 0 THEN w{i}{j} / {total} ELSE 0.25 END AS j{i}{j}" for i, j in pairs)
    mean = ", ".join(f"j0{j} + j1{j} AS n{j}, CASE WHEN j0{j} + j1{j} > 1e-300 THEN (j0{j} * b0{j} + j1{j} * b1{j}) / (j0{j} + j1{j}) ELSE mu{j} END AS y{j}" for j in (0, 1))
    var = ", ".join(f"CASE WHEN n{j} > 1e-300 THEN (j0{j} * (c0{j} + power(y{j} - b0{j}, 2)) + j1{j} * (c1{j} + power(y{j} - b1{j}, 2))) / n{j} ELSE q{j} + r{j} END" for j in (0, 1))
    keys = "series, chunk_id, i, ts, row_id, v, lm, lo, hi"
    step = "SELECT n.series, n.chunk_id, n.i, n.ts, n.row_id, n.v, n.lm, n.lo, n.hi, n.mu0, n.mu1, n.q0, n.q1, n.r0, n.r1, n.z, k.p0, k.p1, k.m0, k.m1, k.v0, k.v1, greatest(n.dt / n.ref, 1e-6) AS sc, power(0.9, greatest(n.dt / n.ref, 1e-6)) AS keep FROM rec k JOIN kk n ON n.series = k.series AND n.chunk_id = k.chunk_id AND n.i = k.i + 1"
    return (
        _POSITIVE
        + f""", l AS (SELECT *, ln(v) AS z FROM s WHERE v > 0), ld AS (SELECT series, z - lag(z) OVER {_W} AS d FROM l),
cq AS (SELECT series, avg(z) AS lm, min(z) AS lo, max(z) AS hi, quantile_cont(z, 0.25) - avg(z) AS mu0, quantile_cont(z, 0.75) - avg(z) AS mu1 FROM l GROUP BY series),
cn AS (SELECT series, greatest(power(1.4826 * mad(d) / sqrt(2.0), 2), 1e-4) AS r FROM ld GROUP BY series),
sa AS (SELECT series, (us - lag(us) OVER {_W}) / 6e7 AS dt FROM s), cx AS (SELECT series, coalesce(median(dt) FILTER (dt > 0 AND dt < 180), 10.0) AS ref FROM sa GROUP BY series),
kk AS (SELECT q.*, ln(v) - lm AS z, lm, lo, hi, mu0, mu1, r * 0.1 AS q0, r * 0.1 AS q1, r * 3 AS r0, r * 3 AS r1, ref FROM q JOIN n USING (series, chunk_id) JOIN cq USING (series) JOIN cn USING (series) JOIN cx USING (series)),
rec AS (
SELECT {keys}, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1, z AS m0, z AS m1, q0 + r0 AS v0, q1 + r1 AS v1 FROM kk WHERE i = 1
UNION ALL
SELECT {keys}, n0, n1, y0, y1, {var} FROM (SELECT *, {mean} FROM (SELECT *, {joint} FROM (SELECT *, {branch} FROM (SELECT *, {gain} FROM (SELECT *, {ahead} FROM ({step}) f0) f1) f2) f3) f4) f5)
SELECT series, row_id, ts, {_r("v", "value")}, chunk_id, {_r("exp(greatest(lo, least(hi, p0 * m0 + p1 * m1 + lm)))", "smoothed")} FROM rec"""
    )


for _m in smooth.SMOOTHERS:
    _query(GROUP, f"smooth_{_m}", _kim_sql() if _m == "kim" else None)(lambda rows, m=_m: smooth.smooth(rows, m))
_query(GROUP, "smooth_smc")(smooth.smooth_smc)
_query(
    GROUP,
    "smoothing_log_kim",
    _kim_sql().replace("SELECT series, row_id, ts, ", ", fin AS (SELECT series, row_id, ts, ")
    + """), tot AS (SELECT series, count(*) AS n_rows FROM s GROUP BY series), got AS (SELECT series, count(smoothed) AS n, count(DISTINCT chunk_id) AS k, min(smoothed) AS least FROM fin GROUP BY series)
SELECT series, CASE WHEN n IS NULL OR least <= 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n IS NULL THEN 'no chunk of 10 rows' WHEN least <= 0 THEN 'smoothed values not positive' END AS reason,
  n_rows, coalesce(n, 0) AS n_smoothed, coalesce(k, 0) AS n_chunks, round(least, 6) AS min_smoothed FROM tot LEFT JOIN got USING (series)""",
)(lambda rows: smooth.smoothing_log(rows, smooth.smooth(rows, "kim")))
_query(GROUP, "dglm_forecast")(smooth.forecast)
_query(GROUP, "tune_n_m")(smooth.tune)

# -- profiles and verdicts ----------------------------------------------------------

_query(
    KIND,
    "kde_modes",
    """, w AS (SELECT series, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*), -0.2) AS h FROM s GROUP BY series),
k AS (SELECT w.series, i, sum(exp(-0.5 * power((lo + (hi - lo) * i / 99 - v) / h, 2))) AS y FROM w JOIN s USING (series), range(0, 100) t(i) GROUP BY ALL),
p AS (SELECT series, y > lag(y) OVER (PARTITION BY series ORDER BY i) AND y > lead(y) OVER (PARTITION BY series ORDER BY i) AS up FROM k)
SELECT series, count(*) FILTER (up)::INTEGER AS modes FROM p GROUP BY series""",
)(profile.kde_modes)
_query(KIND, "welch_bands")(profile.spectrum)
_query(KIND, "gmm_bic")(lambda rows: profile.mixture(rows).drop("means", "weights"))
_query(KIND, "adf_test")(profile.unit_root)
_query(KIND, "shapiro_test")(profile.normality)
_query(GROUP, "wide_profile")(lambda rows: profile.wide_profile(gaps.gap_fill(rows)).drop("means", "weights"))
_query(GROUP, "characteristic_verdicts")(lambda rows: profile.characteristic_verdicts(profile.wide_profile(gaps.gap_fill(rows))))


def _smoothed_verdicts(rows: DataFrame) -> DataFrame:
    grid = gaps.gap_fill(smooth.smooth(rows, "kim").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).withColumn("value", F.col("smoothed")).select("series", "ts", "row_id", "value", "us"))
    out = profile.smoothed_verdicts(profile.wide_profile(grid), profile.wide_profile(gaps.gap_fill(rows)))
    return out.withColumn("evidence", F.to_json("evidence"))


_query(GROUP, "smoothed_verdicts")(_smoothed_verdicts)


@_query(GROUP)
def raw_verdicts_full(rows):
    grid = gaps.gap_fill(rows)
    return profile.raw_verdicts(profile.raw_profile(grid).join(profile.kde_modes(grid), "series").join(profile.island_slope(grid), "series"))


@_query(
    GROUP,
    sql=_GRID
    + f""", o AS (SELECT * FROM g WHERE gap_flag = 0),
a AS (SELECT series, min(v) AS mn, stddev_pop(v) AS sd, median(v) AS md, kurtosis_pop(v) AS ku FROM o GROUP BY series),
r AS (SELECT series, v, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS m FROM o WINDOW w AS (PARTITION BY series ORDER BY us, row_id ROWS 23 PRECEDING)),
vr AS (SELECT series, var_samp(m) / var_pop(v) AS vr FROM r GROUP BY series),
h AS (SELECT series, max(m) - min(m) AS amp FROM (SELECT series, hour(ts), median(v) AS m FROM o GROUP BY ALL) GROUP BY series),
t AS (SELECT series, avg(CASE WHEN abs(dt - 10) < 0.5 THEN 1.0 ELSE 0.0 END) * 100 AS pg, avg(gap_flag) * 100 AS np FROM g GROUP BY series),
c AS (SELECT min(mn) AS mn, median(vr) AS vr, median(amp) AS amp, median(ku) AS ku, median(pg) AS pg, median(np) AS np, avg(sd * sd) AS wi, var_samp(md) AS bt FROM a JOIN vr USING (series) JOIN h USING (series) JOIN t USING (series))
SELECT id, trait, round(evidence, 6) AS evidence, verdict FROM (
SELECT 'H1' AS id, 'Bounded Positive' AS trait, mn AS evidence, CASE WHEN mn > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c
UNION ALL SELECT 'H4', 'Non-Stationary', vr, CASE WHEN vr > 0.1 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'H5', 'Circadian', amp, CASE WHEN amp > 10 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'H6', 'Heavy Tails', ku, CASE WHEN ku > 1 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'H7', 'Irregular Grid', pg, CASE WHEN pg < 95 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'H8', 'Missingness', np, CASE WHEN np > 0 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'H10', 'Between-Series Variance', bt, CASE WHEN bt > wi THEN 'HIGH (Must Normalize)' ELSE 'LOW' END FROM c)""",
)
def cohort_verdicts_raw(rows):
    return profile.raw_verdicts(profile.raw_profile(gaps.gap_fill(rows)))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

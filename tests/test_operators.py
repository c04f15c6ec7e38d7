import datetime as dt
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import describe, detect, gaps, profile, recipes, smooth
from tidemark.plans import catalogue
from tidemark.series import SeriesSpec
from tidemark.sources import files

SPEC = SeriesSpec("k", "ts", "v", "id")
T0 = dt.datetime(2024, 1, 1)


def frame(spark, minutes, values=None, key="a"):
    values = values or [float(i) for i in range(len(minutes))]
    data = [(key, T0 + dt.timedelta(minutes=m), v, i) for i, (m, v) in enumerate(zip(minutes, values, strict=True))]
    return SPEC.normalise(spark.createDataFrame(data, "k string, ts timestamp_ntz, v double, id long"))


@pytest.mark.parametrize("gap, fillers, chunks", [(179, 0, 1), (180, 0, 2), (181, 18, 2), (190, 18, 2), (191, 19, 2)])
def test_gap_and_chunk_thresholds(spark, gap, fillers, chunks):
    rows = frame(spark, [0, 10, 10 + gap])
    grid = gaps.gap_fill(rows).orderBy("us").collect()
    assert sum(r.gap_flag for r in grid) == fillers
    assert [r.minute_diff for r in grid][1] == 10 and grid[0].minute_diff is None
    assert gaps.chunks(rows).agg(F.max("chunk_id")).first()[0] == chunks


def test_gap_fill_twice_is_once(spark):
    rows = frame(spark, [0, 10, 400, 1000])
    once = gaps.gap_fill(rows)
    again = gaps.gap_fill(once.select("series", "ts", "row_id", "value", "us"))
    assert once.count() == again.count()


def test_islands_split_at_nulls_and_chunks_do_not(spark):
    rows = frame(spark, [0, 10, 20, 30], [1.0, None, 3.0, float("nan")])
    assert [r.segment_id for r in gaps.islands(rows).orderBy("us").collect()] == [1, 2, 3, 4]
    assert gaps.chunks(rows).agg(F.max("chunk_id")).first()[0] == 1


def test_normalise_coerces(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", "1.5", 1), ("a", "no time", "2", 2), ("a", "2024-01-01 00:10:00", "x", 3)], "k string, ts string, v string, id long")
    got = SPEC.normalise(df).orderBy("row_id").collect()
    assert [(r.row_id, r.value) for r in got] == [(1, 1.5), (3, None)]


def test_merge_back_never_multiplies_equal_times(spark):
    rows = frame(spark, [0, 10, 10, 20])
    assert gaps.merge_back(gaps.gap_fill(rows), rows.withColumn("x", F.col("value")), "x").count() == 4


def test_centred_mean_window(spark):
    rows = frame(spark, list(range(0, 2000, 10)))
    got = [r.trend for r in describe.centred_mean(rows).orderBy("us").collect()]
    assert got[100] == pytest.approx(np.mean(np.arange(28, 172)))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    data, i = [], 0
    for user in range(25):
        t = T0 + dt.timedelta(minutes=float(rng.uniform(0, 500)))
        for _ in range(60):
            step = rng.choice([rng.uniform(8, 12), 10.0, 180.0, rng.uniform(181, 900)], p=[0.6, 0.3, 0.03, 0.07])
            t += dt.timedelta(seconds=int(step * 60))
            data.append((i, t, user, ["view", "click", "buy"][user % 3], float(np.round(rng.gamma(4, 12), 2))))
            i += 1
    top = tmp_path_factory.mktemp("events")
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{top}/events.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_agrees_with_sql(spark, events, name):
    got = catalogue.queries()[name](spark, events).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda d: d[cols].apply(lambda c: c.astype(float).map(lambda x: f"{x:.6g}") if c.dtype.kind in "fi" else c.astype(str))
    a, b = (text(d).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) and a.equals(b)


@pytest.mark.parametrize("method", sorted(smooth.SMOOTHERS))
def test_smoothers_bound_and_keep_rows(spark, events, method):
    rows = SeriesSpec("user_id").normalise(spark.read.parquet(f"{events}/events.parquet"))
    done = smooth.smooth(rows, method).toPandas()
    want = smooth.observed_chunks(rows).count()
    lim = rows.where("value > 0").groupBy("series").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).toPandas()
    done = done.merge(lim, on="series")
    assert len(done) == want > 100
    assert ((done.smoothed > 0) & (done.smoothed >= done.lo - 1e-9) & (done.smoothed <= done.hi + 1e-9)).all()


def test_chunks_do_not_touch_each_other(spark):
    a, b = list(range(0, 300, 10)), list(range(1000, 1300, 10))
    rng = np.random.default_rng(1)
    v = [float(x) for x in rng.uniform(30, 60, 60)]
    par = ["lo", "hi"]
    both = smooth.smooth(frame(spark, a + b, v), "kim").where("chunk_id = 2").orderBy("ts").toPandas()
    swapped = smooth.smooth(frame(spark, [x + 2000 for x in a] + b, v), "kim").where("chunk_id = 1").orderBy("ts").toPandas()
    # The noise estimate alone sees across chunks, so the same readings in another order differ little.
    assert par and np.abs(both.smoothed - swapped.smoothed).max() < 3


def test_tuning_query_takes_the_longest_island_whole(spark, tmp_path, monkeypatch):
    data = [(i, T0 + dt.timedelta(minutes=10 * i), 3, "view", 40.0 + i % 7) for i in range(560)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    taken, cut = [], gaps.longest_segment
    monkeypatch.setattr(gaps, "longest_segment", lambda grid, most: taken.append(cut(grid, most)) or taken[-1])
    catalogue.queries()["tune_n_m"](spark, str(tmp_path))
    assert [seg.count() for seg in taken] == [500]


def test_particle_query_uses_the_published_numbers(spark, events, monkeypatch):
    held, grouped = [], smooth._grouped
    monkeypatch.setattr(smooth, "_grouped", lambda parts, part, smoother, seed: held.append(smoother) or grouped(parts, part, smoother, seed))
    monkeypatch.setattr(smooth.filters, "smooth_smc", lambda t, v, p, seed, n, paths: (n, paths))
    catalogue.queries()["smooth_smc"](spark, events)
    assert [s.run(None, None, None, 0) for s in held] == [(250, 50)]


def test_annotation_and_markers(spark, events):
    rows = SeriesSpec("user_id").normalise(spark.read.parquet(f"{events}/events.parquet"))
    done = detect.annotate(smooth.smooth(rows, "kim"))
    assert {r[0] for r in done.select("cpd_input_col").distinct().collect()} == {"smoothed"}
    for m in detect.METHODS:
        bad = done.where(f"NOT {m}_degree BETWEEN 0 AND 1 OR {m}_type NOT IN ('normal', 'transition', 'shift', 'medium', 'adverse')")
        assert bad.count() == 0
    found = detect.markers(done)
    assert found.where("method = 'kalman'").count() == 0  # it has no shifts
    assert detect.marker_union(found).count() <= found.count()
    assert detect.annotation_log(done).count() == done.select("series").distinct().count()


def test_recipes(spark, events):
    df = spark.read.parquet(f"{events}/events.parquet")
    spec = SeriesSpec("user_id")
    grid, log = recipes.preprocess(df, spec)
    assert log.agg(F.sum("n_rows")).first()[0] == grid.count()
    more = df.limit(1).selectExpr("event_id", "CAST(NULL AS TIMESTAMP_NTZ) AS ts", "900L AS user_id", "event_type", "value")
    _, log = recipes.preprocess(df.unionByName(more), spec, df.limit(1).selectExpr("901L AS series"))
    assert {(r.series, r.reason) for r in log.where("status = 'failed'").collect()} == {(900, "no reading has a time"), (901, "no readings found")}
    smoothed, log = recipes.smooth_grid(df, spec, "gpssm")
    assert smoothed.count() == grid.count() and smoothed.where("gap_flag = 1 AND smoothed IS NOT NULL").count() == 0
    assert {r.status for r in log.collect()} <= {"success", "failed"}
    assert recipes.backfill_trend(grid).columns[:4] == ["series", "ts", "value", "minute_diff"]


def test_raw_files(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    put('"0001"/hrv/part-0.csv', "﻿createdTime , hrvValue\n2024-01-01 00:00:00,40\nbad,41\n")
    put('"0001"/hrv/part-1.csv', "hrvValue,createdTime\n42,2024-01-01 00:10:00\n")
    put('"0001"/hrv/_part-2.csv', "hrvValue,createdTime\n99,2024-01-01 00:20:00\n")
    put("0001/hrv/part-0.csv", "hrvValue,createdTime\n98,2024-01-01 00:20:00\n")
    put("0002/hrv/part-0.csv", "createdTime,other\n2024-01-01 00:00:00,1\n")
    put("0003/hrv/part-0.csv", "x\n")
    (tmp_path / "users.txt").write_text('"0001"\n\n"0002"\n 0004 \n')
    put("deep/er/0005/hrv/part-0.csv", "createdTime,hrvValue\n2024-01-01 00:30:00,50\n")
    found = files.scan_files(spark, str(tmp_path), "hrv", "createdTime", "hrvValue")
    assert sorted((r.series, r.status, r.reason) for r in found.collect()) == [("0001", "success", None)] * 2 + [("0002", "failed", "columns missing"), ("0003", "failed", "file too small"), ("0005", "success", None)]
    raw = files.read_readings(spark, str(tmp_path), "hrv", "createdTime", "hrvValue").where("series <> '0005'")
    rows = SeriesSpec("series", "createdTime", "hrvValue", "hrvValue").normalise(raw).orderBy("ts").collect()
    assert [(r.series, r.value) for r in rows] == [("0001", 40.0), ("0001", 42.0)]
    roster = files.read_roster(spark, str(tmp_path / "users.txt"))
    assert sorted(r.series for r in files.missing_series(roster, raw).collect()) == ["0002", "0004"]


def test_stage_tables(spark, tmp_path):
    rows = gaps.gap_fill(frame(spark, [0, 10, 400]))
    files.write_stage(rows, f"{tmp_path}/stage")
    assert files.read_stage(spark, f"{tmp_path}/stage", "a").count() == rows.count()
    files.replace_stage(files.read_stage(spark, f"{tmp_path}/stage").withColumn("x", F.lit(1)), f"{tmp_path}/stage")
    assert "x" in files.read_stage(spark, f"{tmp_path}/stage").columns
    os.makedirs(f"{tmp_path}/stage/v-9-broken/bucket=0")  # a write that broke off
    assert files.read_stage(spark, f"{tmp_path}/stage").count() == rows.count() and len(os.listdir(f"{tmp_path}/stage")) == 2
    assert files.markdown(rows.select("series", "gap_flag")).count("\n") == rows.count() + 1


def test_one_pass_profiles_agree_with_the_single_operators(spark, events):
    rows = SeriesSpec("event_type").normalise(spark.read.parquet(f"{events}/events.parquet"))
    grid = gaps.gap_fill(rows)
    wide = {r["series"]: r for r in profile.wide_profile(grid).collect()}
    ratio = {r["series"]: r["var_ratio"] for r in describe.value_stats(grid).collect()}
    parts = [
        describe.describe(grid), describe.bimodality(grid), describe.rolling_std_cv(grid), describe.within_diff_stats(grid), describe.step_stats(grid), describe.null_rate(grid), describe.autocorrelation(grid).drop("n", "acf_bound"),
        profile.spectrum(grid), profile.mixture(grid), profile.unit_root(grid).withColumnsRenamed({"p_value": "adf_p"}), profile.normality(grid).withColumnsRenamed({"w": "shapiro_w", "p_value": "shapiro_p"}),
    ]
    for part in parts:
        for r in part.collect():
            for c in part.columns:
                assert wide[r["series"]][c] == (pytest.approx(r[c], rel=1e-9, nan_ok=True) if isinstance(r[c], float) else r[c]), c
    assert ratio == {r["series"]: pytest.approx(r["var_ratio"], rel=1e-9) for r in describe.rolling_mean_ratio(grid).collect()}


def test_verdicts_after_smoothing_follow_the_data(spark):
    fields = "series string, all_positive boolean, is_bimodal boolean, bimodal boolean, mode_gap double, slope double, pct_circadian double, dominant_hours double, is_stationary boolean, rolling_cv double, pct_semidiurnal double, diff_kurt double, near_normal boolean, sigma_x double, median_step_min double, pct_on_grid_steps double, null_pct double, mean double, std double, iqr double"
    row = lambda k, stationary, circ, sx, grid, nulls, mean: (k, True, False, False, 1.0, -2.0, circ, 24.0, stationary, 0.1, 5.0, 1.0, False, sx, 10.0, grid, nulls, mean, 3.0, 4.0)
    raw = spark.createDataFrame([row("a", True, 20.0, 10.0, 60.0, 30.0, 40.0), row("b", False, 20.0, 10.0, 60.0, 30.0, 60.0)], fields)
    same = {r["id"]: r["verdict"] for r in profile.smoothed_verdicts(raw, raw).collect()}
    assert [same[f"H{k}"] for k in (4, 5, 6, 7, 8, 10)] == ["PRESERVED", "PRESERVED", "UNCHANGED", "PRESERVED", "UNCHANGED", "PRESERVED"]
    done = spark.createDataFrame([row("a", False, 40.0, 2.0, 99.0, 0.0, 48.0), row("b", False, 40.0, 2.0, 99.0, 0.0, 52.0)], fields)
    after = {r["id"]: r["verdict"] for r in profile.smoothed_verdicts(done, raw).collect()}
    assert [after[f"H{k}"] for k in (4, 5, 6, 7, 8, 10)] == ["WEAKENED", "STRENGTHENED", "SUBSTANTIALLY REDUCED", "RESOLVED", "RESOLVED", "REDUCED"]


def test_detection_spreads_the_segments_over_tasks(spark, events):
    rows = SeriesSpec("user_id % 10").normalise(spark.read.parquet(f"{events}/events.parquet"))
    found = detect.detect(rows, "bocpd").select("series", F.spark_partition_id().alias("task")).distinct()
    assert found.select("task").distinct().count() > 4 and rows.select("series").distinct().count() == 10

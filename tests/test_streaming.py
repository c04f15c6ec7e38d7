import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate, detect, smooth
from tidemark.series import SeriesSpec
from tidemark.streaming import stateful

SPEC = SeriesSpec("k", "ts", "v", "id")


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    rng, t0, data, i = np.random.default_rng(5), dt.datetime(2024, 1, 1), [], 0
    for k in "ab":
        t = t0
        for _ in range(60):
            t += dt.timedelta(minutes=float(rng.choice([10, 11, 240], p=[0.7, 0.25, 0.05])))
            data.append((k, t, float(rng.uniform(20, 80)), i))
            i += 1
    rows = SPEC.normalise(spark.createDataFrame(data, "k string, ts timestamp_ntz, v double, id long")).cache()
    top = str(tmp_path_factory.mktemp("stream"))
    for j in range(3):  # three triggers in time order
        rows.where(F.col("row_id") % 60 < 20 * (j + 1)).where(F.col("row_id") % 60 >= 20 * j).coalesce(1).write.mode("append").parquet(f"{top}/p{j}")
    return rows, top


def streamed(spark, readings, f, tmp_path, name):
    rows, top = readings
    import os
    import shutil
    import time

    src = tmp_path / "src"
    os.makedirs(src)
    query = f(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    query = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for j in range(3):
            for part in os.listdir(f"{top}/p{j}"):
                if part.endswith(".parquet"):
                    shutil.copy(f"{top}/p{j}/{part}", src / f"{j}-{part}")
            query.processAllAvailable()
            time.sleep(0.1)
    finally:
        query.stop()
    return spark.table(name).toPandas()


def test_linear_filter_streams_as_in_batch(spark, readings, tmp_path):
    rows, _ = readings
    par = calibrate.log_scale(rows).withColumns({"f": F.lit(0.9), "q": F.lit(0.05), "r": F.lit(0.5), "ref_dt": F.lit(10.0)}).cache()
    got = streamed(spark, readings, lambda s: stateful.stream_filter(s, "gpssm", par), tmp_path, "linear")
    parts = smooth.observed_chunks(rows, 1).select("series", "row_id", "ts", "us", "value", "t", "chunk_id")
    want = smooth._grouped(parts.join(par.drop("n_obs"), "series"), "chunk_id", smooth.Smoother(None, smooth.SMOOTHERS["gpssm"].run), 0).toPandas()
    both = got.merge(want, on=["series", "row_id"])
    assert len(both) == len(want) == 120 and np.abs(both.out - both.smoothed).max() < 1e-9


def test_kalman_scores_stream_as_in_batch(spark, readings, tmp_path):
    rows, _ = readings
    got = streamed(spark, readings, lambda s: stateful.stream_filter(s, "kalman_score"), tmp_path, "scores")
    both = got.merge(detect.detect(rows, "kalman").toPandas(), on=["series", "row_id"])
    assert len(both) == 120 and np.abs(np.minimum(both.out / 60, 1) - both.kalman_degree).max() < 1e-9


def test_late_readings_are_told_and_states_end(spark, readings, tmp_path):
    """A reading before the last one is marked; once the watermark is past the gap a series begins afresh."""
    rows, _ = readings
    t0 = 28_400_000 * 60_000_000
    parts = [[("a", 1, 0), ("b", 2, 10)], [("a", 3, 30), ("a", 4, 20)], [("a", 5, 25), ("b", 6, 900)], [("b", 7, 2000)], [("a", 8, 2001)]]
    src = tmp_path / "late"
    src.mkdir()
    query = stateful.stream_filter(spark.readStream.schema("series string, row_id long, us long, value double").option("maxFilesPerTrigger", 1).parquet(str(src)), "kalman_score", delay="10 minutes")
    query = query.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        for k, part in enumerate(parts):
            data = [(s, i, t0 + m * 60_000_000, 40.0 + i) for s, i, m in part]
            spark.createDataFrame(data, "series string, row_id long, us long, value double").coalesce(1).write.parquet(f"{tmp_path}/l{k}")
            for f in sorted((tmp_path / f"l{k}").glob("*.parquet")):
                f.rename(src / f"{k}-{f.name}")
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r.row_id: r for r in spark.table("late").collect()}
    assert sorted(got) == list(range(1, 9)) and [i for i in got if got[i].late] == [5]
    assert got[5].out is None and got[6].out == got[7].out == got[8].out == 0.0 and got[3].out > 0

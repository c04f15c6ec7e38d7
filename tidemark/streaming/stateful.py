"""Streaming forms of causal filters, with a frozen calibration.

State is one series' filter state and last time; a gap of 180 minutes or more
starts it afresh, as between chunks in batch. Readings of one trigger are sorted
by time. A reading older than the state's last time comes out with ``late`` true
and no value, so it can be counted. A state ends when the watermark has passed
its last time by the gap: nothing it knows would be used again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.changes import kalman_step
from tidemark.functions.filters import linear_start, linear_step

GAP = 180.0


def _linear(state, dt, value, p):
    z = math.log(value) - p["log_mean"]
    state = linear_start(z, p["q"], p["r"]) if state is None else linear_step(*state, z, max(dt / p["ref_dt"], 1e-6), p["f"], p["q"], p["r"])
    return state, math.exp(min(max(state[0] + p["log_mean"], p["log_lo"]), p["log_hi"]))


def _kalman(state, dt, value, p):
    return kalman_step(state, dt, value)


#: name: (step, numbers in the state besides the time, calibration columns)
STEPS = {"gpssm": (_linear, 2, ["f", "q", "r", "ref_dt", "log_mean", "log_lo", "log_hi"]), "kalman_score": (_kalman, 5, [])}


def stream_filter(rows: DataFrame, method: str, calibration: DataFrame | None = None, delay: str = "2 days") -> DataFrame:
    """(series, row_id, us, value, out, late) of a stream of normalised positive readings; ``calibration`` is a static table.

    Readings more than ``delay`` behind the newest of all series don't reach their
    state; Spark counts them in the query's progress (numRowsDroppedByWatermark).
    """
    step, size, params = STEPS[method]
    if params:
        rows = rows.join(calibration.select("series", *params), "series")
    key, row = (rows.schema[c].dataType.simpleString() for c in ("series", "row_id"))

    def run(series, batches: Iterator, state):
        import pandas as pd

        columns = ["series", "row_id", "us", "value", "out", "late"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        last, *rest = state.get if state.exists else (None,)
        now = tuple(rest) if last is not None else None
        pdf = pd.concat(list(batches)).sort_values(["us", "row_id"])
        kept = []
        for r in pdf.to_dict("records"):
            t, known = r["us"] / 60e6, (r["series"], r["row_id"], r["us"], r["value"])
            if last is not None and t < last:
                kept.append((*known, None, True))
                continue
            if last is not None and t - last >= GAP:
                now = None
            now, out = step(now, 0.0 if now is None else t - last, r["value"], r)
            last = t
            kept.append((*known, out, False))
        if now is not None:
            state.update((float(last), *(float(x) for x in now)))
            state.setTimeoutTimestamp(max(int((last + GAP) * 60_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=columns).astype({"out": float, "late": bool})

    timed = rows.where(F.col("value") > 0).withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    fields = ", ".join(f"s{i} double" for i in range(size + 1))
    schema = f"series {key}, row_id {row}, us long, value double, out double, late boolean"
    return timed.select("series", "row_id", "us", "at", "value", *params).groupBy("series").applyInPandasWithState(run, schema, fields, "append", "EventTimeTimeout")


def stream_chunks(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Chunk summaries of a stream (series, chunk_start, chunk_end, n, mean): session windows that end after a gap of 180 minutes.

    The window is a microsecond short of the gap, so that two readings exactly 180
    minutes apart are in two chunks; late readings beyond ``delay`` are dropped.
    """
    timed = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    window = F.session_window("at", "10799999999 microseconds")
    return timed.groupBy("series", window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("at").alias("chunk_start"), F.max("at").alias("chunk_end")).drop("w")

"""Change-point annotation: detectors on segments, markers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import changes
from tidemark.operators.gaps import chunks
from tidemark.series import observed

DETECTORS = {"bocpd": changes.bocpd, "bocpd_run_length": changes.bocpd_run_length, "kcp": changes.kcp, "kalman": changes.kalman, "hmm": changes.hmm}
METHODS = ("bocpd", "kcp", "kalman", "hmm")
#: Among fewer tasks a few long series would often share one.
LEAST_TASKS = 128
#: What each method calls a change when markers are asked for alarms.
ALARMS = {"kalman": "adverse"}


def detect(rows: DataFrame, methods=METHODS, by_chunk: bool = True) -> DataFrame:
    """(series, row_id, ts, value, chunk_id, <m>_type, <m>_degree ...) of the rows with values.

    Each chunk is a segment of its own; with ``by_chunk`` False gaps are closed and
    the whole series is one. Rows without a value have no type.
    """
    methods = [methods] if isinstance(methods, str) else list(methods)
    seen = rows.where(observed())
    cut = chunks(seen) if by_chunk else seen.withColumn("chunk_id", F.lit(1).cast("long"))
    cut = cut.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("series", "chunk_id"))) / 60e6)
    key, row = (rows.schema[c].dataType.simpleString() for c in ("series", "row_id"))

    def run(pdf):
        pdf = pdf.sort_values(["us", "row_id"])
        out = pdf[["series", "row_id", "ts", "value", "chunk_id"]].copy()
        for m in methods:
            out[f"{m}_type"], out[f"{m}_degree"] = DETECTORS[m](pdf["t"].to_numpy(float), pdf["value"].to_numpy(float))
        return out

    schema = f"series {key}, row_id {row}, ts timestamp_ntz, value double, chunk_id long, " + ", ".join(f"{m}_type string, {m}_degree double" for m in methods)
    # The chunks would stay where the windows put their series, and several long series in one task.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_TASKS)
    return cut.select("series", "row_id", "ts", "us", "value", "t", "chunk_id").repartition(tasks, "series", "chunk_id").groupBy("series", "chunk_id").applyInPandas(run, schema)


def annotate(smoothed: DataFrame, methods=METHODS) -> DataFrame:
    """All detectors on the trend where the table has one, else on the smoothed values; cpd_input_col names the column."""
    col = "trend" if "trend" in smoothed.columns else "smoothed"
    rows = smoothed.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return detect(rows.select("series", "row_id", "ts", "us", F.col(col).alias("value")), methods).withColumn("cpd_input_col", F.lit(col))


def markers(annotated: DataFrame, methods=METHODS, alarms: bool = False) -> DataFrame:
    """(series, method, ts, degree) of the rows a method marks ``shift``; with ``alarms`` also Kalman's ``adverse``."""
    stack = ", ".join(f"'{m}', {m}_type, {m}_degree" for m in methods)
    long = annotated.selectExpr("series", "ts", f"stack({len(methods)}, {stack}) AS (method, type, degree)")
    hit = F.col("type") == "shift"
    if alarms:
        for m, name in ALARMS.items():
            hit = hit | ((F.col("method") == m) & (F.col("type") == name))
    return long.where(hit).select("series", "method", "ts", "degree")


def marker_union(found: DataFrame) -> DataFrame:
    """(series, ts): times that any method marks."""
    return found.select("series", "ts").distinct()


def annotation_log(annotated: DataFrame, methods=METHODS, rows: DataFrame | None = None) -> DataFrame:
    """(series, status, reason, n_rows, n_<method>): rows a method calls other than normal; series of ``rows`` that have no annotated row fail."""
    kinds = [F.count_if(F.col(f"{m}_type") != "normal").alias(f"n_{m}") for m in methods]
    found = annotated.groupBy("series").agg(F.count("*").alias("n_rows"), *kinds)
    if rows is not None:
        found = rows.select("series").distinct().join(found, "series", "left")
    reason = F.when(F.col("n_rows").isNull(), "no rows with values")
    return found.select("series", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("reason"), "n_rows", *[f"n_{m}" for m in methods])

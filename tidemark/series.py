"""The engine's data model: readings of many series in one DataFrame.

A normalised frame has the columns ``series``, ``ts`` (timestamp without zone),
``us`` (microseconds since 1970), ``row_id`` (tie-break) and ``value`` (NULL:
missing; NaN never occurs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MINUTE = 60_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})")


def from_micros(us: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {us}, {_EPOCH})")


@dataclass(frozen=True)
class SeriesSpec:
    """Where a table keeps key, time, value and tie-break (SQL expressions)."""

    key: str
    ts: str = "ts"
    value: str = "value"
    tiebreak: str = "event_id"

    def normalise(self, df: DataFrame) -> DataFrame:
        """Coerced and filtered readings: rows without a time go, values that are no numbers become NULL."""
        ts = F.expr(f"try_cast({self.ts} AS TIMESTAMP_NTZ)")
        value = F.expr(f"try_cast({self.value} AS DOUBLE)")
        rows = df.select(
            F.expr(self.key).alias("series"), ts.alias("ts"), F.expr(self.tiebreak).alias("row_id"), F.when(~F.isnan(value), value).alias("value")
        ).where("ts IS NOT NULL")
        return rows.withColumn("us", micros("ts"))


def ordered(*keys: str) -> WindowSpec:
    """Rows of a series (and whatever else ``keys`` name) in time order."""
    return Window.partitionBy(*(keys or ("series",))).orderBy("us", "row_id")


def observed() -> Column:
    return F.col("value").isNotNull()


def positive() -> Column:
    """Observed for the smoothers that work in logarithms."""
    return F.col("value").isNotNull() & (F.col("value") > 0) & (F.col("value") < float("inf"))

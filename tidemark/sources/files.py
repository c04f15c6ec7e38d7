"""Raw CSV trees, rosters, stage tables, logs and reports."""

from __future__ import annotations

import time as clock
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(series): the ids of a text file, one a line, blanks and quotes stripped."""
    ids = F.regexp_replace(F.trim("value"), '^"+|"+$', "")
    return spark.read.text(path).select(ids.alias("series")).where("series <> ''")


def find_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, bytes) of all files under ``root``, however deep, whose name fits; hidden ones and those that begin with "_" are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("bytes"))


def _folder(path: Column, up: int) -> Column:
    return F.element_at(F.split(path, "/"), -up)


def scan_files(spark: SparkSession, root: str, modality: str, time: str, value: str, least_bytes: int = 10) -> DataFrame:
    """A row a CSV file of a modality: (series, path, bytes, header, status, reason).

    A folder with a quoted name is preferred to one with the bare name. Files under
    ``least_bytes``, files that can't be read and files without both columns fail.
    """
    files = find_files(spark, root).where(_folder(F.col("path"), 2) == modality).where(~_folder(F.col("path"), 1).rlike(r"^[._]"))
    name = _folder(F.col("path"), 3)
    files = files.select(F.regexp_replace(name, '^"+|"+$', "").alias("series"), name.startswith('"').alias("quoted"), "path", "bytes")
    quoted = files.where("quoted").select("series").distinct().withColumn("prefers", F.lit(True))
    files = files.join(quoted, "series", "left").where("quoted OR prefers IS NULL").drop("quoted", "prefers")
    large = [r["path"] for r in files.where(F.col("bytes") >= least_bytes).select("path").collect()]
    heads = spark.createDataFrame([], "path string, header string")
    if large:
        lines = _lenient(spark).text([_escaped(p) for p in large]).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        heads = lines.where("at = 0").groupBy(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")).agg(F.first("value").alias("header"))
    cells = F.transform(F.split("header", ","), lambda c: F.trim(c, F.lit('" \ufeff\t')))
    whole = F.array_contains(cells, time) & F.array_contains(cells, value)
    reason = F.when(F.col("bytes") < least_bytes, "file too small").when(F.col("header").isNull(), "file unreadable").when(~whole, "columns missing")
    # Paths of one file system are written with one slash or three after the scheme.
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    out = files.withColumn("__k", key(F.col("path"))).join(heads.select(key(F.col("path")).alias("__k"), "header"), "__k", "left")
    return out.select("series", "path", "bytes", "header", F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("reason"))


def _lenient(spark: SparkSession):
    """A reader that passes over files it can't read."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")


def read_readings(spark: SparkSession, root: str, modality: str, time: str, value: str, least_bytes: int = 10, files: DataFrame | None = None) -> DataFrame:
    """(series, <time>, <value>) as strings, of all files that ``scan_files`` (or its result ``files``) calls a success.

    Spark binds the columns of several CSV files by the first one's header, so
    files are read in groups of equal headers; header cells are stripped of blanks
    and byte-order marks.
    """
    files = scan_files(spark, root, modality, time, value, least_bytes) if files is None else files
    groups: dict[str, list[str]] = {}
    for r in files.where("status = 'success'").select("header", "path").collect():  # a reader has to be told its paths
        groups.setdefault(r["header"], []).append(_escaped(r["path"]))
    parts = []
    for head, paths in groups.items():
        cells = [c.strip('" \ufeff\t') for c in head.split(",")]
        schema = ", ".join(f"c{i} string" for i in range(len(cells)))
        rows = _lenient(spark).csv(paths, schema=schema, header=True, enforceSchema=True)
        folder = F.url_decode(F.replace(_folder(F.col("_metadata.file_path"), 3), F.lit("+"), F.lit("%2B")))
        parts.append(rows.select(F.regexp_replace(folder, '^"+|"+$', "").alias("series"), F.col(f"c{cells.index(time)}").alias(time), F.col(f"c{cells.index(value)}").alias(value)))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], f"series string, {time} string, {value} string"))


def _escaped(path: str) -> str:
    """A literal path for Spark's readers, which take brackets and stars for patterns."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def missing_series(roster: DataFrame, readings: DataFrame) -> DataFrame:
    """Log rows of roster entries without readings."""
    gone = roster.join(readings.select("series").distinct(), "series", "left_anti")
    return gone.select("series", F.lit("failed").alias("status"), F.lit("no readings found").alias("reason"))


def select_series(df: DataFrame, part: str | None) -> DataFrame:
    """Series whose id contains ``part``; all of them without it."""
    return df if not part else df.where(F.col("series").cast("string").contains(part))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of a stage's complete versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    found = [s.getPath() for s in fs.listStatus(hadoop(path)) if s.getPath().getName().startswith("v-")]
    return sorted(p.toString() for p in found if fs.exists(hadoop(p, "_SUCCESS")))


def write_stage(df: DataFrame, path: str, buckets: int = 64) -> None:
    """A stage's table as Parquet, dealt to ``buckets`` folders by series: many series share a folder, readers prune by it.

    Every write is a version of its own beside those before, which are removed once
    it is complete. Readers take the last complete one, so a write that breaks off
    at any point leaves the stage as it was, and a stage can be rewritten from itself.
    """
    spark, old = df.sparkSession, _versions(df.sparkSession, path)
    bucket = F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int")
    fresh = f"{path}/v-{clock.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.withColumn("bucket", bucket).repartition("bucket", "series").sortWithinPartitions("series", "ts").write.partitionBy("bucket").parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for gone in old:
        hadoop(gone).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(gone), True)


def read_stage(spark: SparkSession, path: str, series=None, buckets: int = 64) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    df = spark.read.parquet(versions[-1])
    if series is not None:
        df = df.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(series)), F.lit(buckets)).cast("int")).where(F.col("series") == series)
    return df.drop("bucket")


def replace_stage(df: DataFrame, path: str) -> None:
    """Rewrites a stage from itself."""
    write_stage(df, path)


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(table: DataFrame, most: int = 50) -> str:
    """A Markdown table of at most ``most`` rows of a report."""
    rows = table.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(table.columns), "|" + "-|" * len(table.columns), *[line(r) for r in rows]])

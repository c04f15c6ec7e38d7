"""Sharding by extendible hashing.

A directory maps prefixes of a 60-bit hash to shards. Starting from one bucket
for everything, only buckets over the byte limit split on one more bit, until
all shards fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

HASH_BITS = 60
#: Bits split off in one pass; a bucket's part of the directory is at most 2 ** STRIDE cells then.
STRIDE = 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a long (NULL: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _split(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """Directory of one pass over ``rows`` (prefix, bits, n_bytes) whose buckets at ``depth`` are too large:
    (cell, at): the depth at which the cell's bucket fits, NULL if it doesn't at ``depth + STRIDE``."""
    low = HASH_BITS - depth - STRIDE
    cells = rows.groupBy(F.shiftright("bits", low).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(0 if depth == 0 else 1), F.lit(STRIDE))).alias("level"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {STRIDE} - level)"))
    fits = levels.groupBy("level", "bucket").agg(F.sum("n_bytes").alias("total")).where(F.col("total") <= limit)
    found = levels.join(fits, ["level", "bucket"]).groupBy("cell").agg(F.min("level").alias("level"))
    return cells.select("cell").join(found, "cell", "left").select("cell", (F.col("level") + depth).alias("at"))


def shard(docs: DataFrame, limit: int = 64 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth, part) of every row of ``docs``.

    ``shard`` is the hash prefix in binary digits ("" for the whole), ``depth`` its
    length, n_bytes the UTF-8 bytes of the text (NULL: 0). The hash covers the key,
    so rows of one key stay together; where they alone exceed ``limit``, the bucket
    is cut into ``part`` 0, 1, ... by a second hash table over the texts and, for
    equal rows, by their numbers. A single row above the limit is a part of its own.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(text).alias("th"))
    rows = materialize(rows.withColumn("bits", hash_bits(F.col("key"))), "sizes")
    done, todo, depth = None, rows, 0
    while depth < HASH_BITS:
        table = _split(todo, depth, limit)
        placed = todo.withColumn("cell", F.shiftright("bits", HASH_BITS - depth - STRIDE)).join(table, "cell").drop("cell")
        placed = materialize(placed, "placed")
        ready = placed.where("at IS NOT NULL").withColumn("part", F.lit(0).cast("long"))
        done = ready if done is None else done.unionByName(ready)
        todo = placed.where("at IS NULL").drop("at")
        if todo.isEmpty():
            todo = None
            break
        depth += STRIDE
    if todo is not None:
        done = done.unionByName(_overflow(todo, limit).withColumn("at", F.lit(HASH_BITS)))
    digits = F.substring(F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("at").cast("int"))
    return done.select(F.col("key").alias(key), "n_bytes", digits.alias("shard"), F.col("at").cast("int").alias("depth"), "part")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose whole hash is shared by more than ``limit`` bytes, with part numbers.

    The rows of a key are summed in 1,024 cells by text hash and task; each cell is
    cut into parts of its own, so no task has to hold a key.
    """
    cells = rows.withColumn("lane", F.pmod(F.xxhash64("th", F.spark_partition_id()), F.lit(1024)))
    inner = Window.partitionBy("bits", "lane").orderBy("th", "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    cells = materialize(cells.withColumn("upto", F.sum("n_bytes").over(inner)), "lanes")
    # A row belongs to the part in which its first byte falls; halves of the limit leave room for it.
    half = max(1, limit // 2)
    cells = cells.withColumn("local", F.when(F.col("n_bytes") > half, F.lit(None)).otherwise(F.floor((F.col("upto") - F.col("n_bytes")) / half)))
    large = cells.where("local IS NULL").withColumn("local", F.monotonically_increasing_id())
    small = cells.where("local IS NOT NULL").withColumn("lone", F.lit(False))
    both = materialize(small.unionByName(large.withColumn("lone", F.lit(True))), "parts")
    parts = both.select("bits", "lane", "lone", "local").distinct()
    numbered = parts.withColumn("part", F.row_number().over(Window.partitionBy("bits").orderBy("lone", "lane", "local")).cast("long") - 1)
    return both.join(numbered, ["bits", "lane", "lone", "local"]).select("key", "n_bytes", "th", "bits", "part")


def directory(shards: DataFrame) -> DataFrame:
    """(shard, depth, part, n_rows, shard_bytes): the directory with its buckets' sizes."""
    return shards.groupBy("shard", "depth", "part").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("shard_bytes"))

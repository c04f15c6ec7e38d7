"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

A schedule of slots, each one equal-token block long, is laid out by a
golden-ratio sequence: slot ``i`` maps the point ``frac(i / phi)`` through the
cumulative target weights to a source. Slots are ranked per source, the sources'
shuffled documents are cut into blocks of as many words, and rank ``r`` is joined
with block ``r`` of the (repeating) stream of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize
from tidemark.llm.streams import buckets_for, stream_offsets

WORD = r"[^\x20\x09-\x0D]+"
#: floor(2**32 / golden ratio), fixed value.
GOLDEN = 2654435769
#: Slots are ranked in runs of so many.
RUN = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(key: Column, seed: int) -> Column:
    """A long whose bits, taken without sign, order keys like the first 15 digits of the MD5 of "seed:key" (NULL: "seed:")."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15)
    return F.shiftleft(F.conv(digits, 16, 10).cast("long"), 4)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, rank, source_size, target) of sized documents; one row a source.

    Sources in code-point order, NULL last, take ``weights`` in turn. With
    ``t = min(cap, w * level)`` water fills the caps (``max_repeat`` times the
    source's size): the level is the greatest of the levels at which the sources
    before, by cap for weight, are full. One row a source passes through one task.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    src = src.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        filled.rowsBetween(0, Window.unboundedFollowing)
    )
    src = src.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return src.select("source", "rank", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _point(i: Column) -> Column:
    """32-bit golden-ratio point of slot ``i`` (in 16-bit parts, as long products overflow)."""
    high, low = F.shiftright(i, 16) % 65536, i % 65536
    return ((high * GOLDEN) % (1 << 32) * 65536 + low * GOLDEN + (1 << 31)) % (1 << 32)


def _quota(block: int) -> Column:
    """Blocks a source's target asks for; the last may be partial."""
    return F.ceil(F.round("target") / block).cast("long")


def _ranked(placed: DataFrame) -> DataFrame:
    """``placed`` (slot, source_rank) with ``block``, the rank of the slot in its source.

    Ranks in two levels: within a run of slots, after the counts of the runs before.
    """
    placed = placed.select("slot", "source_rank", F.floor(F.col("slot") / RUN).alias("run"))
    runs = placed.groupBy("source_rank", "run").agg(F.count("*").alias("n"))
    prior = Window.partitionBy("source_rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_rank", "run", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source_rank", "run").orderBy("slot")
    return placed.withColumn("r", F.row_number().over(inner) - 1).join(runs, ["source_rank", "run"]).select("slot", "source_rank", (F.col("base") + F.col("r")).alias("block"))


def schedule(spark, targets: DataFrame, total: int, block: int, cells: int = 4096) -> DataFrame:
    """(slot, source_rank, block): which block of which source fills each slot.

    Every source has as many slots as its target asks for. A guide table of
    ``cells`` equal parts of the unit interval names the sources that reach into
    each part, so mapping a point is an equi-join. The points miss a source's
    number by a few at most; the slots that some sources have too many go to the
    sources that have too few.
    """
    quotas = targets.select(F.col("rank").alias("source_rank"), _quota(block).alias("quota"))
    slots = (quotas.agg(F.sum("quota")).first()[0] or 0) if total else 0
    before = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    scale = (1 << 32) / max(slots, 1)
    shares = quotas.select(
        "source_rank",
        F.round(F.coalesce(F.sum("quota").over(before), F.lit(0)) * scale).cast("long").alias("lo"),
        F.round(F.sum("quota").over(upto) * scale).cast("long").alias("hi"),
    ).where("hi > lo")
    width = (1 << 32) // cells
    guide = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") / width))
    placed = materialize(_ranked(points.join(guide, "cell").where("u >= lo AND u < hi")), "placed")
    over = placed.join(F.broadcast(quotas), "source_rank").where("block >= quota").select("slot", F.row_number().over(Window.orderBy("slot")).alias("k"))
    have = placed.groupBy("source_rank").agg(F.count("*").alias("n"))
    short = quotas.join(have, "source_rank", "left").withColumn("short", F.col("quota") - F.coalesce("n", F.lit(0))).where("short > 0")
    short = short.select("source_rank", F.explode(F.sequence(F.lit(1).cast("long"), "short")).alias("i"))
    moved = over.join(short.select(F.col("source_rank").alias("to"), F.row_number().over(Window.orderBy("i", "source_rank")).alias("k")), "k").select("slot", "to")
    placed = placed.join(F.broadcast(moved), "slot", "left").select("slot", F.coalesce("to", "source_rank").alias("source_rank"))
    return _ranked(placed)


def mix(docs: DataFrame, id_col: str = "doc_id", weights=(5, 2, 1), max_repeat: int = 3, seed: int = 17, resolution: int = 100_000, max_block: int = 4096, keep: tuple = ()) -> DataFrame:
    """Words the mixture takes of each document.

    ``docs`` has ``id_col``, ``source`` and ``size`` (long words); the result adds
    source_rank, source_size, target and taken, one row a row of ``docs``. A block
    is a ``resolution``-th of all words, at most ``max_block`` words; a source's
    last block ends at its target, so each source gives its target. NULL source
    is a source of its own, a NULL id an id like any other; repeated rows are
    separate documents; documents without words are taken 0 times; no rows, no
    result. Columns named in ``keep`` come along and order rows that are equal otherwise.
    """
    spark = docs.sparkSession
    kept = [f"__keep{i}" for i in range(len(keep))]
    docs = docs.select(F.col(id_col).alias("doc_id"), "source", F.col("size").cast("long").alias("size"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    docs = materialize(docs, "sizes")
    total = docs.agg(F.sum("size")).first()[0] or 0
    block = min(max_block, max(8, total // resolution))
    targets = source_targets(docs, weights, max_repeat)
    named = targets.withColumnsRenamed({"source": "s", "rank": "source_rank"})
    rows = docs.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("h", shuffled(F.col("doc_id"), seed))
    rows = stream_offsets(rows, "source_rank", "size", ["h", "doc_id", "size", *kept], "at", buckets_for(docs.count()))
    # Where each repeat of a document lies in its source's stream, cut by block.
    epochs = F.ceil((F.col("target") + 4 * block) / F.greatest(F.col("source_size"), F.lit(1)))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_repeat), F.greatest(epochs, F.lit(1))).cast("int") - 1)))
    start = F.col("epoch") * F.col("source_size") + F.col("at")
    rows = rows.withColumn("start", start).withColumn("stop", start + F.col("size"))
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))))
    words = F.least("stop", (F.col("block") + 1) * block, F.round("target").cast("long")) - F.greatest("start", F.col("block") * block)
    pieces = pieces.withColumn("words", F.greatest(words, F.lit(0)))
    slots = schedule(spark, targets, total, block)
    joined = pieces.join(slots, ["source_rank", "block"], "left")
    keys = ["source_rank", "at", "h", "doc_id", "source", "size", "source_size", "target", *kept]
    taken = joined.groupBy(*keys, "epoch").agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken"), F.count_if(F.col("block").isNull()).alias("copies"))
    # Rows of no words share their place: as many rows come back as went in.
    taken = taken.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.max("copies").alias("copies"))
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return taken.select("doc_id", "source", "size", "source_rank", "source_size", "target", F.col("taken").cast("long").alias("taken"), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])

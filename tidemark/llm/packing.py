"""Mixture-controlled packing of token sequences.

Each source is a queue of tokens served in turns of ``quantum`` tokens. Deficit
round-robin credits a source with its weight's share of every token that is
packed and serves it a turn whenever its deficit is half a turn: its ``k``-th
turn comes when the round counter reaches ``(k + 1/2) * quantum / weight``. A
source is then never more than a turn ahead of or behind its share, and what it
is behind at the end of one window (or of one partition of windows) is carried to
the next, since the counter is global. A queue that is empty has no more turns;
the others then share the windows by their weights. The order of turns is thus
known without running the scheduler from the start: turns are dealt to ranges of
the counter, ordered within each, and placed after the token counts of the ranges
before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.encoding import chunks, encoder
from tidemark.llm.storage import lean, materialize
from tidemark.llm.streams import buckets_for, stream_offsets, sums_before

#: Tokens of a range of turns, which a task orders.
RANGE = 500_000


def tokenized(docs: DataFrame, tokenizer: str, style: str, end_id: int) -> DataFrame:
    """``docs`` (doc_id, source, text) to (doc_id, source, ids binary of 16-bit ids with the end id)."""
    end = end_id.to_bytes(2, "little")

    def encode(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, style)
        for b in batches:
            for i, texts in chunks(b.column("text")):
                ids = [x + end for x in enc.encode(texts)]
                part = b.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(ids, pa.binary())], ["doc_id", "source", "ids"])

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, ids binary"
    return docs.select("doc_id", "source", "text").mapInArrow(lean(encode), schema)


def pack(docs: DataFrame, tokenizer: str, style: str = "byte", end_id: int = 1, window: int = 2048, quantum: int = 128, seed: int = 23, weights: dict | None = None) -> DataFrame:
    """Pieces of all documents in gapless windows of ``window`` tokens.

    Returns doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. ``weights`` are target proportions by source (1 for a source it lacks);
    without them they are the sources' token totals, so that every queue lasts to
    the end and every window has the corpus's proportions. All windows but the
    last are full. A NULL or empty text is its end id alone; a NULL source is a
    queue of its own; repeated rows are packed as often as they occur; no rows give
    no pieces.
    """
    toks = tokenized(docs, tokenizer, style, end_id).withColumn("rid", F.monotonically_increasing_id())
    toks = materialize(toks.withColumn("n", (F.octet_length("ids") / 2).cast("long")), "ids")
    rows = toks.select("rid", "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("queue"), "n")
    totals = rows.groupBy("queue").agg(F.sum("n").alias("total"))
    if weights is None:
        weight = F.ceil(F.col("total") / quantum).cast("double")
    else:
        named = [x for s, w in weights.items() for x in (F.lit("" if s is None else f"={s}"), F.lit(float(w)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*named), F.col("queue")), F.lit(1.0)) if named else F.lit(1.0)
    totals = totals.withColumn("weight", weight)
    # Tokens that all queues together serve while the counter goes from one range to the next.
    span = RANGE / quantum / (totals.agg(F.sum("weight")).first()[0] or 1.0)
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "rid"))
    rows = stream_offsets(rows, "queue", "n", ["h", "rid"], "at", buckets_for(toks.count())).join(totals, "queue")
    turn = F.col("turn")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.floor(F.col("at") / quantum), F.floor((F.col("at") + F.col("n") - 1) / quantum))))
    pos = F.greatest("at", turn * quantum)
    length = F.least(F.col("at") + F.col("n"), (turn + 1) * quantum) - pos
    pieces = rows.select("rid", "queue", pos.alias("pos"), (pos - F.col("at")).alias("start"), length.alias("length"), ((turn + 0.5) / F.col("weight")).alias("round"))
    pieces = pieces.withColumn("range", F.floor(F.col("round") / span))
    sums = sums_before(pieces.groupBy("range").agg(F.sum("length").alias("tokens")), "range", "tokens", "base").select("range", "base")
    inner = Window.partitionBy("range").orderBy("round", "queue", "pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("within", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(sums, "range")
    placed = placed.withColumn("at", F.col("base") + F.col("within"))
    # Cut where a window ends.
    seq = F.col("sequence_id")
    placed = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window))))
    first = F.greatest("at", seq * window)
    last = F.least(F.col("at") + F.col("length"), (seq + 1) * window)
    placed = placed.select("rid", (F.col("start") + first - F.col("at")).alias("start"), (last - first).alias("length"), "sequence_id", (first - seq * window).alias("offset"))
    joined = toks.join(placed.hint("shuffle_hash"), "rid")
    ids = F.substring("ids", (F.col("start") * 2 + 1).cast("int"), (F.col("length") * 2).cast("int"))
    out = joined.select("doc_id", "source", "start", "length", ids.alias("ids"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return _with_crc(out)


def _with_crc(pieces: DataFrame) -> DataFrame:
    """Replaces ``ids`` by the CRC-32 of the ids as little-endian 32-bit integers."""

    def crc(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column("ids").cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(ids) + 1] // 2 if len(ids) else np.zeros(1, np.int64)
            wide = np.frombuffer(ids.buffers()[2] or b"", "<u2")[ends[0] : ends[-1]].astype("<u4") if len(ids) else np.empty(0, "<u4")
            data, ends = memoryview(wide.tobytes()), ((ends - ends[0]) * 4).tolist()
            sums = [zlib.crc32(data[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            at = b.schema.get_field_index("ids")
            yield b.set_column(at, "ids_crc32", pa.array(sums, pa.int64()))

    schema = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in pieces.schema])
    return pieces.mapInArrow(lean(crc), schema)


"""Corpus pipeline: quality, near duplicates, secrets, mixture, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), is
judged on what its predecessor kept, and returns a DataFrame. All but the last
return the columns of documents. Stages judge rows, not ids: a row is known by
its file and its place there, so rows that repeat an id, or have none, are
documents like any other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, packing, quality, queries, secret_scan, source_mix
from tidemark.llm.storage import materialize, read_table, remove, scratch_path, write

#: Packing is not expressible in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: struct<file hash, row number>, the same however often and wherever a row is read.

    What does not come from files is written to the shared folder first.
    """
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.withColumn("__row", row)
    except AnalysisException:
        return materialize(docs, "documents").withColumn("__row", row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that importance resampling keeps.

    Rows with the same id and text are kept or rejected together; a NULL id draws
    its noise like any other, NULL and empty texts weigh 0; an empty table stays empty.
    """
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join stays: the one with the least id.

    NULL ids come last; of rows that tie, the first by place stays. A document
    without words is linked with nothing, so all such rows stay; an empty table
    stays empty.
    """
    rows = _with_row(docs)
    found = jaccard_join.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("order"))
    groups = ids.join(found, "__row")
    firsts = groups.groupBy("component_id").agg(F.min("order")["__row"].alias("__row")).select("__row")
    return rows.join(firsts, "__row", "left_semi").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret replaced by a mark; n_chars follows the text.

    NULL texts stay NULL; ids play no part; an empty table stays empty.
    """
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "ledger"))
    rows = docs.withColumn("__path", F.col("doc_id"))
    out = secret_scan.redact(rows, "__path", "text", ledger)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mixture takes: a row for each whole or partial copy of a row, none for rows not taken.

    Only the row at which a source's share ends is cut, after so many words. Each
    of several equal rows has a share of its own; rows without words are not
    taken; NULL sources are a source; an empty table stays empty.
    """
    rows = _with_row(docs).withColumn("__size", source_mix.word_count(F.col("text")))
    taken = source_mix.mix(rows.select("doc_id", "source", F.col("__size").alias("size"), F.col("__row").alias("row")), keep=("row",))
    taken = taken.where("taken > 0").select(F.col("row").alias("__row"), F.col("taken").alias("__taken"))
    copies = rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    words = F.regexp_extract_all("text", F.lit(source_mix.WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")
    copies = copies.withColumn("text", F.when(left < F.col("__size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(left < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return copies.select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's rows in windows of 2048 tokens.

    Equal rows are packed as often as they occur; NULL texts are their end id
    alone; an empty table gives no pieces.
    """
    pieces = packing.pack(docs.select("doc_id", "source", "text"), queries.vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back, the one before removed."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage{k}")
        docs = write(out, path)
        if last:
            remove(spark, last)
        last = path
    return docs

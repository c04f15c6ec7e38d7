"""A bounded, reproducible sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids never learned from: crc32 of the id as text, modulo 5, is 0 (NULL id: as "")."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 5, skip_held_out: bool = True) -> DataFrame:
    """(doc_id, text, label int) of at most ``bound`` labelled documents, chosen by a hash of the id.

    The chosen ids are at most ``bound`` rows, so they are broadcast and only the
    sample is shuffled. Of an id that occurs several times, the text with the least
    hash stands for it, whatever the number of rows. Conflicting labels of an id:
    the greatest; labels other than 0 and 1, and NULL ids, are left out; no labels
    or no documents give an empty sample.
    """
    ids = labels.where(F.col(label).cast("int").isin(0, 1) & F.col("doc_id").isNotNull())
    if skip_held_out:
        ids = ids.where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")

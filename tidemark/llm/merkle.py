"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases (DataFrame functions only).

Leaves are runs of at most eight words of one paragraph (line) with the white
space after them; the leaf hash covers its characters. Paragraph nodes hash
their leaves, section nodes hash sixteen paragraphs, the root hashes the
sections. Equal texts have equal roots; for two texts, only branches whose
hashes differ need be followed to locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.streams import ordered_cells

#: Any line is a paragraph: its characters and line feed.
LINE = r"[^\n]*\n|[^\n]+"
#: At most eight words, the white space before and after them included; or white space alone.
PHRASE = r"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,8}+|[\x20\x09-\x0D]++"
SECTION = 16
#: Hexadecimal digits kept of a node's MD5.
DIGITS = 16


def _node(x: Column) -> Column:
    return F.substring(F.md5(x), 1, DIGITS)


def leaves(text: Column) -> Column:
    """array<array<string>>: leaf hashes of each paragraph."""
    lines = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    return F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), _node))


def paragraphs(leaf: Column) -> Column:
    return F.transform(leaf, lambda p: _node(F.array_join(p, "")))


def sections(para: Column) -> Column:
    count = F.ceil(F.size(para) / SECTION).cast("int")
    return F.when(
        F.size(para) > 0,
        F.transform(F.sequence(F.lit(0), count - 1), lambda k: _node(F.array_join(F.slice(para, k * SECTION + 1, F.lit(SECTION)), ""))),
    ).otherwise(F.array().cast("array<string>"))


def tree(leaf: Column) -> Column:
    """struct<root, sections, paragraphs> over a text's leaves; the empty text has the root of no sections."""
    para = paragraphs(leaf)
    sect = sections(para)
    return F.struct(_node(F.array_join(sect, "")).alias("root"), sect.alias("sections"), para.alias("paragraphs"))


def fingerprint(leaf: Column) -> Column:
    """root, then section hashes, then leaf hashes: ``root:sections:leaves`` with hashes run together."""
    t = tree(leaf)
    return F.concat_ws(":", t["root"], F.array_join(t["sections"], ""), F.array_join(F.flatten(leaf), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaf hashes by all distinct leaf hashes; two texts without leaves are alike."""
    x, y = F.array_distinct(F.flatten(a)), F.array_distinct(F.flatten(b))
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of paragraphs in which two trees (``tree`` structs) differ.

    Sections with equal hashes are skipped without looking at their paragraphs.
    """
    many = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    differ = lambda k, f: ~F.get(a[f], k).eqNullSafe(F.get(b[f], k))
    sect = F.when(a["root"] != b["root"], F.filter(F.sequence(F.lit(0), many - 1), lambda k: differ(k, "sections")))
    para = F.flatten(F.transform(sect, lambda k: F.sequence(k * SECTION, k * SECTION + SECTION - 1)))
    return F.coalesce(F.filter(para, lambda k: differ(k, "paragraphs")), F.array().cast("array<int>"))


def _next_cells(cells: DataFrame, span: int = 4096) -> DataFrame:
    """(cell, follower): the greatest cell below each of the distinct ``cells``; of the least, the greatest of all.

    Two levels: within a span of numbers by a window of its own, between spans by
    one over the spans that have cells, so no task orders all cells.
    """
    spans = cells.withColumn("span", F.floor(F.col("cell") / span))
    ends = spans.groupBy("span").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    ends = ends.select("span", "low", F.coalesce(F.lag("high").over(Window.orderBy("span")), F.max("high").over(Window.partitionBy())).alias("before"))
    inner = spans.withColumn("prior", F.lag("cell").over(Window.partitionBy("span").orderBy("cell")))
    firsts = ends.select(F.col("low").alias("cell"), F.col("before").alias("follower"))
    return inner.where("prior IS NOT NULL").select("cell", F.col("prior").alias("follower")).unionByName(firsts)


def with_next(docs: DataFrame, rows_per_cell: int = 256) -> DataFrame:
    """``docs`` (doc_id, text not null) with ``next_text``: the text of the next document in descending doc_id, after the last of the first.

    Neighbours meet in one cell of the order; only the last row of each cell looks
    up the first text of the next cell. Equal ids go by text hash; NULL ids come last.
    """
    cell = ordered_cells(docs, "doc_id", rows_per_cell)
    rows = docs.withColumn("cell", cell).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("cell").orderBy(F.col("doc_id").desc(), "h")
    rows = rows.withColumn("lead_text", F.lead("text").over(order))
    firsts = docs.withColumn("cell", cell).withColumn("h", F.xxhash64("text"))
    # The first row of each cell, found on narrow columns before its text is fetched.
    heads = firsts.groupBy("cell").agg(F.max("doc_id").alias("top"))
    hashes = firsts.select("cell", "doc_id", "h").join(heads, "cell").where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = hashes.groupBy("cell", "doc_id").agg(F.min("h").alias("h"))
    chain = _next_cells(heads.select("cell"))
    lookup = heads.alias("a").join(chain.alias("c"), F.col("a.cell") == F.col("c.follower")).select(F.col("c.cell").alias("cell"), F.col("a.doc_id").alias("hd"), F.col("a.h").alias("hh"))
    text = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("dh"), F.col("text").alias("head_text"))
    texts = text.join(lookup, F.col("d").eqNullSafe(F.col("hd")) & (F.col("dh") == F.col("hh"))).groupBy("cell").agg(F.min("head_text").alias("head_text"))
    # The rows are still dealt and sorted by cell; a cell without a row after has no lead.
    return rows.join(texts, "cell", "left").select("doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A NULL text is empty. Repeated rows follow each other; a table of one row is
    its own next document; no rows give no result.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        leaves(F.col("text")).alias("a"), leaves(F.col("edited")).alias("b"), leaves(F.col("next_text")).alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
    )

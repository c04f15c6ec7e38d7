"""Queries of this subpackage, each the thin digest of one operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, media, merkle, packing, quality, secret_scan, sharding, source_mix, token_store, toxicity
from tidemark.llm.storage import read_table, scratch_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text of documents, through a blob ledger that has met about half of them before.

    An earlier batch holds the documents with even hashes; the batch of all then
    scans only the blobs that the ledger lacks, and joins findings to all paths.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.update(docs.where(F.xxhash64("doc_id") % 2 == 0), "doc_id", "text")
    found = secret_scan.scan_paths(docs, "doc_id", "text", ledger)
    spans = F.array_join(F.transform("found", lambda s: s["label"]), ",")
    return found.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(o, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
  (2, 'hex', '[0-9a-f]+', 0, 16)),
parts AS (
  SELECT doc_id, o, kind, least, gaps, found, vals FROM (
    SELECT doc_id, 0 AS o, 'assign' AS kind, 12 AS least,
      string_split_regex(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps,
      regexp_extract_all(t, (SELECT pat FROM rules WHERE o = 0), 0) AS found,
      regexp_extract_all(t, (SELECT pat FROM rules WHERE o = 0), 2) AS vals FROM docs
    UNION ALL SELECT doc_id, 1, 'access', 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM docs
    UNION ALL SELECT doc_id, 2, 'hex', 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) FROM docs) p
  WHERE len(found) > 0),
hits AS (
  SELECT doc_id, o, kind, least, i, length(gaps[i]) AS gap, length(found[i]) AS l, length(vals[i]) AS v
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM parts)),
spans AS (
  SELECT doc_id, o, kind, v >= least AS ok, sum(gap + l) OVER (PARTITION BY doc_id, o ORDER BY i) AS e, l FROM hits),
digest AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
    string_agg(kind || ':' || (e - l)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - l, o) AS s
  FROM spans WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM docs d LEFT JOIN digest USING (doc_id)
"""


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; ``name`` is looked up where the package has been installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mixture of all sources takes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", source_mix.word_count(F.col("text")).alias("size"))
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


# A source's taken words are those of its repeating stream up to its target.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap, sum(source_size::DOUBLE) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, round(target) AS stop,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(pos + size, stop) - pos) + greatest(0, least(source_size + pos + size, stop) - source_size - pos) + greatest(0, least(2 * source_size + pos + size, stop) - 2 * source_size - pos))::BIGINT AS taken
FROM p
"""


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media, sniffed, read back and digested."""
    stored = media.store_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.media_features(stored).drop("declared", "corrected")


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document: 64 MB of text at most, by extendible hashing of the id."""
    return sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), labels)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 5-word shingle sets of Jaccard similarity 0.75 or more."""
    found = jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


# All pairs that share a shingle, counted; labels spread along the links.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
s AS MATERIALIZED (SELECT doc_id, len(g) AS n, md5_number_lower(unnest(g)) AS x FROM g),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b
  ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n GROUP BY 1, 2),
h AS MATERIALIZED (SELECT u, v FROM c WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h),
r(x, top) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.v, r.top FROM r JOIN e ON e.u = r.x)
SELECT doc_id, n AS n_shingles, min(top) AS component_id FROM n JOIN r ON r.x = doc_id GROUP BY 1, 2
"""


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to seekable zstandard files and read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_store.write_tokens(docs, scratch_path(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    return token_store.read_index(manifest)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to windows of 2048 tokens in the corpus's proportions of sources."""
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return merkle.fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept by importance resampling."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.resample(docs.select("doc_id", "text"), labels)


# Every depth's buckets are summed, and a document goes to the shallowest that fits.
OP4_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits
  FROM documents),
sums AS (
  SELECT d, bits >> (60 - d) AS prefix FROM sized, range(0, 41) r(d) GROUP BY 1, 2 HAVING sum(n_bytes) <= 67108864),
placed AS (
  SELECT s.*, (SELECT min(d) FROM sums u WHERE u.prefix = s.bits >> (60 - u.d)) AS depth FROM sized s)
SELECT doc_id, n_bytes, substr(lpad(bin(bits), 60, '0'), 1, depth::INTEGER) AS shard, depth::INTEGER AS depth, 0::BIGINT AS part FROM placed
"""

_OP9_WORD, _OP9_GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
_OP9_LEAVES = rf"list_transform(regexp_extract_all({{0}}, '[^\n]*\n|[^\n]+'), lambda p: list_transform(regexp_extract_all(p, '{_OP9_GAP}*(?:{_OP9_WORD}{_OP9_GAP}*){{{{1,8}}}}|{_OP9_GAP}+'), lambda x: md5(x)[:16]))"
_OP9_PRINT = (
    "md5(array_to_string(list_transform(range(0, len({0}), 16), lambda k: md5(array_to_string(list_transform(({0})[k + 1 : k + 16], lambda p: md5(array_to_string(p, ''))[:16]), ''))[:16]), ''))[:16]"
    " || ':' || array_to_string(list_transform(range(0, len({0}), 16), lambda k: md5(array_to_string(list_transform(({0})[k + 1 : k + 16], lambda p: md5(array_to_string(p, ''))[:16]), ''))[:16]), '')"
    " || ':' || array_to_string(flatten({0}), '')"
)
_OP9_LIKE = "CASE WHEN len(list_distinct(flatten({0}) || flatten({1}))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(flatten({0})), list_distinct(flatten({1}))))::DOUBLE / len(list_distinct(flatten({0}) || flatten({1}))) END"
OP9_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nxt FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2) AS e FROM pairs),
trees AS (SELECT doc_id, length(t) AS n, sha256(e) AS h, {_OP9_LEAVES.format("t")} AS a, {_OP9_LEAVES.format("e")} AS b, {_OP9_LEAVES.format("nxt")} AS c FROM edits)
SELECT doc_id, n::BIGINT AS n_chars, h AS edited_sha256, {_OP9_PRINT.format("a")} AS fingerprint, {_OP9_PRINT.format("b")} AS edited_fingerprint,
  {_OP9_LIKE.format("a", "b")} AS near_edited, {_OP9_LIKE.format("a", "c")} AS near_next
FROM trees
"""


def queries() -> dict:
    found = (op1_secret_scan, op2_source_mix, op3_media_sniff, op4_extendible_sharding, op5_toxicity, op6_jaccard_join, op7_token_store, op8_mixture_packing, op9_merkle_fingerprint, op10_quality_resampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1_SQL, "op2_source_mix": OP2_SQL, "op6_jaccard_join": OP6_SQL, "op4_extendible_sharding": OP4_SQL, "op9_merkle_fingerprint": OP9_SQL}

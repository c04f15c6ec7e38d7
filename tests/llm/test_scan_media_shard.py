import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_rows import SCHEMA, rows
from pyspark.sql import functions as F

from tidemark.llm import media, merkle, queries, secret_scan, sharding
from tidemark.llm.storage import scratch_path

ASSIGN = re.compile(r"""(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
KINDS = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def spans(text):
    out = []
    for o, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), o, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def texts():
    return {r[0]: r[1] for r in rows()}


def agrees(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, sf_dir, name):
    agrees(spark, sf_dir, name)


TRICKY = [
    "token==\nabcdefghijkl", "token=secret: abcdefghijklmnop", "SECRET = 'abc", 'api_key":"AAAAAAAAAAAA" passwd:bbbbbbbbbbbbb', "AKIAAKIA" + "A" * 14,
    "AKIA" + "Z" * 13, "0123456789abcdef0", "0123456789abcdeF0123456789abcdef", "password=" + "a" * 5000, "é" * 20 + "secret:" + "x" * 12 + "語deadbeefdeadbeef", "paſword=aaaaaaaaaaaaaaa", None, "",
]


def test_spans_match_the_patterns(spark, shared):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)] + [(i + 500, t) for i, t in enumerate(TRICKY)] + [(None, TRICKY[3])], "doc_id long, text string")
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "ledger"))
    got = secret_scan.scan_paths(df, "doc_id", "text", ledger).collect()
    assert len(got) == 2 * len(TRICKY) + 1
    for r in got:
        text = TRICKY[r.path % 500] if r.path is not None else TRICKY[3]
        assert [x["label"] for x in r.found] == [f"{k}:{s}:{e}" for k, s, e in spans(text)]
        assert r.n_assign == sum(k == "assign" for k, _, _ in spans(text))


def test_ledger_scans_only_what_it_has_not_seen(spark, shared):
    df = spark.createDataFrame([(1, "token=abcdefghijklmnop"), (2, "none")], "doc_id long, text string")
    path = scratch_path(spark, "ledger")
    first = secret_scan.BlobLedger(spark, path, secret_scan.RULES[:2])
    secret_scan.scan_paths(df, "doc_id", "text", first)
    again = secret_scan.BlobLedger.open(spark, path, secret_scan.RULES[:2])
    more = df.union(spark.createDataFrame([(3, "none"), (4, "deadbeefdeadbeef"), (5, None)], df.schema))
    got = {r.path: r for r in secret_scan.scan_paths(more, "doc_id", "text", again).collect()}
    assert len(again.batches) == 2 and got[1].n_assign == 1
    assert spark.read.parquet(f"{path}/scans/{again.batches[1]}").count() == 2  # "deadbeef..." and the empty text
    # A new rule runs on all blobs, the old ones do not.
    last = secret_scan.BlobLedger.open(spark, path)
    got = {r.path: r for r in secret_scan.scan_paths(more, "doc_id", "text", last).collect()}
    assert got[4].n_hex == 1 and got[1].n_assign == 1
    fresh = spark.read.parquet(f"{path}/scans/{(set(last.batches) - set(again.batches)).pop()}")
    assert {tuple(r.pending) for r in fresh.collect()} == {("hex@1",)} and fresh.count() == 4


def test_op1_scans_each_blob_in_one_of_its_batches(spark, sf_dir, monkeypatch):
    path = scratch_path(spark, "ledger")
    monkeypatch.setattr(queries, "scratch_path", lambda *_: path)
    queries.op1_secret_scan(spark, sf_dir)
    ledger = secret_scan.BlobLedger.open(spark, path)
    batches = [[bytes(r.blob_id) for r in spark.read.parquet(f"{path}/scans/{b}").collect()] for b in ledger.batches]
    blobs = {hashlib.sha256((t or "").encode()).digest() for t in texts().values()}
    assert len(batches) == 2 and min(map(len, batches)) > 20 and sorted(sum(batches, [])) == sorted(blobs)
    assert ledger.findings().count() == sum(len(spans(t)) for t in {t or "" for t in texts().values()})


def test_redact(spark, shared):
    df = spark.createDataFrame([(1, "a token=abcdefghijklmnop b"), (2, None), (3, "x"), (4, "secret: deadbeefdeadbeef!")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact(df, "doc_id", "text", secret_scan.BlobLedger(spark, scratch_path(spark, "ledger"))).collect()}
    assert got == {1: "a [REDACTED] b", 2: None, 3: "x", 4: "[REDACTED]!"}


def test_scan_of_nothing(spark, no_docs):
    assert secret_scan.scan_paths(no_docs, "doc_id", "text", secret_scan.BlobLedger(spark, scratch_path(spark, "ledger"))).count() == 0


def test_media_round_trip(spark, sf_dir):
    got = queries.op3_media_sniff(spark, sf_dir).collect()
    assert len(got) == len(rows())
    for r in got:
        raw = (texts()[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        kind = media.write_wav if zlib.crc32(payload) % 2 else media.write_png
        assert r.media_sha256 == hashlib.sha256(kind(payload)).hexdigest() and r.media_bytes == len(kind(payload))
    same = {r.payload_sha256: r.feature for r in got}
    assert all(same[r.payload_sha256] == r.feature for r in got)


def test_sniff_carves_and_rejects(spark, shared):
    png, wav = media.write_png(b"a" * 192), media.write_wav(b"b" * 192)
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 12, 0, 54, 40, 2, 1, 1, 32, 0, 0, 0, 0, 0, 0) + b"\0" * 12
    bmp = bmp[:2] + struct.pack("<I", 54 + 8) + bmp[6:62]
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02" + b"\x02\x4c\x01\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab12\xff\x0034\xff\xd9"
    ogg = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
    blob = b"junk" + png + b"RIFF bad" + wav + gif + bmp + jpeg + ogg + b"\x89PNG\r\n\x1a\n..."
    found = media.sniff(blob)
    assert [k for k, _, _ in found] == ["image/png", "audio/wav", "image/gif", "image/bmp", "image/jpeg", "audio/ogg"]
    for (_, s, e), want in zip(found, (png, wav, gif, bmp, jpeg, ogg), strict=True):
        assert blob[s:e] == want
    broken = bytearray(png)
    broken[20] ^= 1
    df = spark.createDataFrame([(1, png, "image/png"), (2, wav, "image/png"), (3, bytes(broken), "image/png"), (4, None, None), (5, b"", None), (6, png[:-1], None)], "id int, blob binary, declared string")
    got = {r.id: r.media for r in media.sniff_column(df, "blob", "declared").collect()}
    assert (got[1].type, got[1].corrected) == ("image/png", False) and (got[2].type, got[2].corrected) == ("audio/wav", True)
    assert got[3].type is None and got[3].corrected and got[4] is None and got[5].carved == [] and got[6].type is None


def test_sniff_finds_media_inside_media(spark, shared):
    thumb = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab12\xff\x0034\xff\xd9"
    png = media.write_png(b"a" * 192)
    photo = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(thumb) + 4) + b"Ex" + thumb + b"\xff\xda\x00\x04ab99\xff\xd9"
    sound = media.write_wav(b"x" + photo + png + b"RIFF" + png[:30])
    blob = sound + png
    at = sound.index(photo)
    want = [("audio/wav", 0, len(sound), 0), ("image/jpeg", at, at + len(photo), 1), ("image/jpeg", sound.index(thumb), sound.index(thumb) + len(thumb), 2), ("image/png", sound.index(png), sound.index(png) + len(png), 1), ("image/png", len(sound), len(blob), 0)]
    assert media.sniff_nested(blob) == want
    assert media.sniff(blob) == [w[:3] for w in want if w[3] == 0]
    df = spark.createDataFrame([(blob, "image/png")], "blob binary, declared string")
    r = media.sniff_column(df, "blob", "declared", nested=True).first().media
    assert r.type == "audio/wav" and r.corrected and [tuple(x) for x in r.carved] == want


def check_shards(got, sizes, limit):
    total = Counter()
    for r in got:
        total[r.shard, r.part] += r.n_bytes
    rows_of = Counter((r.shard, r.part) for r in got)
    assert all(n <= limit or rows_of[k] == 1 for k, n in total.items())
    names = {s for s, _ in total}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a directory: no shard is a prefix of another
    by_prefix = Counter()
    for r in got:
        for k in range(r.depth):
            by_prefix[r.shard[:k]] += r.n_bytes
    assert all(n > limit for n in by_prefix.values())  # only oversized buckets were split


def test_sharding_fits_and_splits_no_more_than_it_must(spark, small_docs):
    got = sharding.shard(small_docs, 2000).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts())
    assert all(r.n_bytes == len((texts()[r.doc_id] or "").encode()) for r in got)
    check_shards(got, None, 2000)
    assert sharding.directory(sharding.shard(small_docs, 2000)).agg(F.sum("n_rows")).first()[0] == len(got)


def test_sharding_one_hot_key(spark, shared):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(8, "y" * 10)] * 3 + [(None, None)] * 2 + [(9, "z" * 5000)], "doc_id long, text string")
    got = sharding.shard(df, 1000).collect()
    assert Counter(r.doc_id for r in got) == {7: 50, 8: 3, None: 2, 9: 1}
    total, n = Counter(), Counter()
    for r in got:
        total[r.shard, r.part] += r.n_bytes
        n[r.shard, r.part] += 1
    assert all(t <= 1000 or n[k] == 1 for k, t in total.items())


def test_sharding_nothing(spark, no_docs):
    assert sharding.shard(no_docs).count() == 0


def test_merkle_chain_equality_and_edits(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op9_merkle_fingerprint(spark, sf_dir).collect()}
    ids, t = sorted(texts(), reverse=True), texts()
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        a, b = t[i] or "", t[nxt] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (a == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (a != edited or r.near_edited == 1)
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[t[i] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) == len(by_text)
    long = [r for i, r in got.items() if i < 500 and len(t[i] or "") > 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_merkle_locates_edits(spark, shared):
    lines = [f"line {i} has a few more words than eight in it" for i in range(100)]
    other = list(lines)
    other[37] = other[37].replace("few", "many")
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("a", "a"), ("", "b")], "a string, b string")
    trees = df.select(merkle.tree(merkle.leaves(F.col("a"))).alias("a"), merkle.tree(merkle.leaves(F.col("b"))).alias("b"))
    assert [list(r.x) for r in trees.select(merkle.changed_paragraphs(F.col("a"), F.col("b")).alias("x")).collect()] == [[37], [], [0]]


def test_merkle_leaves_cover_the_text(spark, small_docs):
    lines = F.regexp_extract_all("text", F.lit(merkle.LINE), F.lit(0))
    parts = F.array_join(F.flatten(F.transform(lines, lambda p: F.regexp_extract_all(p, F.lit(merkle.PHRASE), F.lit(0)))), "")
    assert small_docs.where("text IS NOT NULL").where(parts != F.col("text")).count() == 0


def test_merkle_single_and_repeated_rows(spark, no_docs):
    one = spark.createDataFrame([(1, "abcd", "en", "s", 4)], SCHEMA)
    assert merkle.fingerprint_edits(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    twice = spark.createDataFrame([(1, "abcd", "en", "s", 4)] * 2 + [(None, None, None, None, None)], SCHEMA)
    assert merkle.fingerprint_edits(twice).count() == 3
    assert merkle.fingerprint_edits(no_docs).count() == 0

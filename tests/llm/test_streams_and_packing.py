import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import SCHEMA, rows
from pyspark.sql import functions as F

from tidemark.llm import packing, queries, source_mix, token_store
from tidemark.llm.storage import scratch_path
from tidemark.llm.streams import ordered_cells, stream_offsets, sums_before


def encode(name, texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary(name))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_stream_offsets_is_a_prefix_sum(spark, small_docs):
    df = small_docs.select("source", "doc_id", F.length("text").alias("size")).na.fill(0, ["size"]).na.fill("", ["source"])
    got = stream_offsets(df.withColumn("h", F.xxhash64("doc_id")), "source", "size", ["h", "doc_id"], "at", buckets=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append((r["at"], r["size"]))
    for spans in by.values():
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size


def test_ordered_cells_follow_the_ids(spark):
    df = spark.createDataFrame([(x,) for x in [None, -5, -5, 0, 1, 2, 3, 10**15, 2**62, *range(100, 400)]], "id long")
    got = sorted(df.select("id", ordered_cells(df, "id", 16, 8).alias("c")).collect(), key=lambda r: (r.id is not None, r.id or 0))
    assert [r.c for r in got] == sorted(r.c for r in got) and got[0].c == -1 and len({r.c for r in got}) > 8


def reference_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        t = {s: 3.0 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix_meets_its_targets(spark, sf_dir):
    got = queries.op2_source_mix(spark, sf_dir).collect()
    docs = {r[0]: r for r in rows()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for i, d in docs.items()}
    by = Counter()
    for i, d in docs.items():
        by[d[3]] += size[i]
    target, taken = reference_targets(by), Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == by[docs[r.doc_id][3]]
        assert r.target == pytest.approx(target[docs[r.doc_id][3]], rel=1e-9, abs=1e-6)
        taken[docs[r.doc_id][3]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 48), (s, taken[s], t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op2_source_mix(spark, sf_dir).collect()))


def test_schedule_is_low_discrepancy(spark, small_docs):
    df = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "source string, size long")
    targets = source_mix.source_targets(df, weights=(1, 1, 1))
    want = {r["rank"]: r["target"] / 1000 for r in targets.collect()}
    got = source_mix.schedule(spark, targets, 1000, 1).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(1000))
    seen = Counter()
    for i, r in enumerate(got, 1):
        assert r["block"] == seen[r.source_rank]
        seen[r.source_rank] += 1
        assert all(abs(seen[s] - share * i) < 6 for s, share in want.items())


def test_mix_gives_tiny_sources_beside_a_huge_one_their_targets(spark, shared):
    huge = [(i, "huge", 1_000_000) for i in range(80)]
    tiny = [(1000 + i, f"tiny{i:02}", 60 + 20 * i) for i in range(12)]
    df = spark.createDataFrame(huge + tiny + [(2000, "two blocks", 700)], "doc_id long, source string, size long")
    got = source_mix.mix(df).collect()
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert len(target) == 14 and min(target.values()) >= 60
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def test_mix_repeated_rows_and_no_rows(spark, no_docs):
    df = spark.createDataFrame([(1, "a", 50)] * 3 + [(2, None, 0)] * 2 + [(None, "b", 10)], "doc_id long, source string, size long")
    got = source_mix.mix(df).collect()
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 2, None: 1}
    assert source_mix.mix(no_docs.selectExpr("doc_id", "source", "0L AS size")).count() == 0


def check_packing(got, texts, window):
    want = dict(zip(texts, encode("byte_bpe_50k.json", texts.values(), 1), strict=True))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    assert set(pieces) == set(want)
    for k, ps in pieces.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[k])
    fill = {}
    for k, spans in windows.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        fill[k] = at
    assert sorted(fill) == list(range(len(fill))) and all(fill[k] == window for k in range(len(fill) - 1)) and 0 < fill[len(fill) - 1] <= window


def test_packing_covers_every_id_once(spark, sf_dir):
    got = queries.op8_mixture_packing(spark, sf_dir).collect()
    check_packing(got, {r[0]: r[1] for r in rows()}, 2048)


def test_packing_keeps_proportions(spark, small_docs):
    pieces = packing.pack(small_docs, queries.vocabulary("byte_bpe_50k.json"), window=512, quantum=16).collect()
    total, so_far, all_tokens = Counter(), defaultdict(Counter), 0
    for r in pieces:
        total[r.source] += r.length
        so_far[r.sequence_id][r.source] += r.length
        all_tokens += r.length
    run = Counter()
    for k in range(max(so_far) + 1):
        run.update(so_far[k])
        done = sum(run.values())
        for s, t in total.items():
            assert abs(run[s] - t * done / all_tokens) <= (1 + len(total) / 2) * 16  # each queue within a turn of the common counter


def test_packing_to_target_proportions(spark, shared):
    """Weights other than the corpus's: each window's proportions, with what is owed carried on, until a queue is empty."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 200))), "en", s, 0) for i, s in enumerate(["a"] * 60 + ["b"] * 20 + [None] * 20 + ["rest"] * 10)]
    df, weights = spark.createDataFrame(docs, SCHEMA), {"a": 1.0, "b": 5.0, None: 2.0}
    pieces = packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), window=256, quantum=32, weights=weights).collect()
    check_packing(pieces, {r[0]: r[1] for r in docs}, 256)
    left, served, dry = Counter(), Counter(), False
    share = {"a": 1.0, "b": 5.0, None: 2.0, "rest": 1.0}
    for r in pieces:
        left[r.source] += r.length
    for k in range(max(r.sequence_id for r in pieces) + 1):
        mine = [r for r in pieces if r.sequence_id == k]
        for r in mine:
            left[r.source] -= r.length
            served[r.source] += r.length
        if dry := dry or min(left.values()) < 64:
            break
        done = sum(served.values())
        for s, w in share.items():
            assert abs(served[s] - done * w / 9) <= 32 * 3, (k, s)
    assert dry and k > 10


def test_sums_before(spark):
    values = {k: k % 7 for k in [0, 5, 4095, 4096, 9000, 10**9, 2**40]}
    got = {r["at"]: r["out"] for r in sums_before(spark.createDataFrame(list(values.items()), "at long, n long"), "at", "n", "out").collect()}
    assert got == {k: sum(v for x, v in values.items() if x < k) for k in values}


def test_packing_nothing(spark, no_docs):
    assert packing.pack(no_docs, queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_store_round_trip(spark, sf_dir):
    got = queries.op7_token_store(spark, sf_dir).orderBy("doc_id").collect()
    data = sorted((r[0], r[1]) for r in rows())
    at = 0
    for r, (i, _), ids in zip(got, data, encode("word_bpe_49k.json", [t for _, t in data], 2), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)


def test_token_store_reads_only_what_is_asked(spark, small_docs, no_docs):
    vocab = queries.vocabulary("word_bpe_49k.json")
    manifest = token_store.write_tokens(small_docs.select("doc_id", "text"), scratch_path(spark, "t"), vocab)
    got = {r.doc_id: r.ids for r in token_store.read_documents(manifest, [3, 703]).collect()}
    texts = {r[0]: r[1] for r in rows()}
    assert got == dict(zip([3, 703], encode("word_bpe_49k.json", [texts[3], texts[703]], 2), strict=True))
    path = manifest.first().path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    import zstandard

    frames = [f for f in token_store.read_frames(path)]
    assert zstandard.ZstdDecompressor().decompress(bytes(raw), max_output_size=1 << 20, read_across_frames=False, allow_extra_data=True)
    raw[5] ^= 0xFF
    bad = path + ".bad"
    open(bad, "wb").write(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        list(token_store.read_frames(bad))
    assert len(frames) > 1 and len(list(token_store.read_frames(bad, [len(frames) - 1]))) == 1
    assert token_store.read_index(token_store.write_tokens(no_docs.select("doc_id", "text"), scratch_path(spark, "t"), vocab)).count() == 0


def test_packing_repeated_ids(spark, shared):
    df = spark.createDataFrame([(1, "same text", "en", "a", 1)] * 3, SCHEMA)
    got = packing.pack(df, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == 3 and sum(r.length for r in got) == 3 * got[0].doc_tokens

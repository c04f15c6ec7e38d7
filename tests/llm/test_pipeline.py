import re
from collections import Counter

import corpus_pipeline
from llm_rows import rows
from test_models_and_join import brute_components
from test_scan_media_shard import spans
from test_streams_and_packing import check_packing

from tidemark.llm import quality, storage
from tidemark.llm.storage import read_table, scratch_path, write


def redacted(text):
    out, at = "", 0
    for _, s, e in spans(text):
        if s >= at:
            out += text[at:s] + "[REDACTED]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs, results = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, path = stage(spark, docs, sf_dir), scratch_path(spark, "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append(docs.collect())
    raw = {r[0]: r[1] for r in rows()}
    kept = {r.doc_id for r in quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).collect()}
    assert {r.doc_id for r in results[0]} == kept
    want = {i for i, (_, c) in brute_components({i: raw[i] for i in kept}).items() if i == c}
    assert {r.doc_id for r in results[1]} == want
    assert {r.doc_id: r.text for r in results[2]} == {i: raw[i] if raw[i] is None else redacted(raw[i]) for i in want}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    before = {r.doc_id: words(r.text) for r in results[2]}
    copies = Counter()
    for r in results[3]:
        copies[r.doc_id] += 1
        got = words(r.text)
        assert got == before[r.doc_id][: len(got)] and got
    assert max(copies.values()) <= 3
    total = sum(map(len, before.values()))
    assert abs(sum(len(words(r.text)) for r in results[3]) - total) < 0.03 * total + 200
    if max(copies.values()) == 1:
        check_packing(results[4], {r.doc_id: r.text for r in results[3]}, 2048)
    lengths = Counter()
    for r in results[4]:
        lengths[r.sequence_id] += r.length
    assert all(lengths[k] == 2048 for k in range(len(lengths) - 1))


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def odd_rows():
    """Repeated rows, NULL ids, one id with several texts, NULL and empty texts."""
    long = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"thing{i}" for i in range(40))
    near = long.replace("word39", "else")
    rows = [(1, long, "en", "a", 7)] * 3 + [(2, other, "en", "a", 7), (2, near, "en", "a", 7), (None, long, "en", "a", 7), (None, "alone here", "en", None, 7), (None, "alone here", "en", None, 7)]
    return rows + [(5, None, "en", "b", None), (5, None, "en", "b", None), (6, "", "en", "b", 0), (7, "secret=abcdefghijkl tail", "en", "b", 0), (None, "secret=abcdefghijkl tail", "en", "b", 0)]


def test_stages_judge_rows(spark, shared, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = write(spark.createDataFrame(odd_rows(), schema), scratch_path(spark, "odd"))
    quality_, near, secrets, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    empty = scratch_path(spark, "labels")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{empty}/labels.parquet")
    assert quality_(spark, docs, empty).count() == docs.count()  # nothing labelled: all rows stay, NULL ids too
    kept = near(spark, docs, sf_dir).collect()
    # One of the group of the long text (its copies and the near one), the other text of id 2, one "alone", one secret, all without words.
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, odd_rows()[0][1]), (2, odd_rows()[3][1]), (None, "alone here"), (5, None), (5, None), (6, ""), (7, "secret=abcdefghijkl tail")])
    # A table that is no file is taken as it is.
    assert near(spark, spark.createDataFrame(odd_rows(), schema), sf_dir).count() == len(kept)
    clean = secrets(spark, docs, sf_dir).collect()
    assert Counter(r.text for r in clean) == Counter(t if t is None else redacted(t) for _, t, *_ in odd_rows())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(t) for _, t, *_ in odd_rows())
    got = mixed(spark, docs, sf_dir).collect()
    assert sum(words(r.text) for r in got) == total
    wanted = mixed(spark, write(spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 6 + [(2, "x " * 400, "en", "t", 0)], schema), scratch_path(spark, "mix")), sf_dir).collect()
    # Targets 5 : 2 of 418 words, the first stopped at three times its 18.
    assert sum(words(r.text) for r in wanted if r.source == "s") == 54 and sum(words(r.text) for r in wanted if r.source == "t") == 364
    pieces = packed(spark, docs, sf_dir)
    assert pieces.groupBy().sum("length").first()[0] == sum(r.doc_tokens for r in pieces.where("start = 0").collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_workers_give_back_what_arrow_holds(spark, small_docs, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import jaccard_join

    seen, calls = [], []
    plain = type(small_docs).mapInArrow
    monkeypatch.setattr(type(small_docs), "mapInArrow", lambda self, run, *a, **k: (seen.append(run), plain(self, run, *a, **k))[1])
    found = quality._weighed(small_docs, np.zeros(quality.BUCKETS), 0)
    jaccard_join._profiles(small_docs.select("doc_id", "text"), "bigint")
    assert found.count() == small_docs.count()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], ["doc_id", "text"])
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    out = list(seen[0](iter([batch, batch])))
    assert [b.num_rows for b in out] == [2, 2] and calls == [1]
    list(seen[1](iter([batch])))
    assert calls == [1, 1]


def test_driver_gives_back_native_memory(spark, shared, monkeypatch):
    """After every table: what the JVM of the driver has freed goes back to the system."""
    assert "Trim native heap" in (storage.give_back(spark) or "")
    calls, give_back = [], storage.give_back
    monkeypatch.setattr(storage, "give_back", lambda s: calls.append(give_back(s)))
    with storage.Scratch(spark, "test") as space:
        assert space.keep(spark.range(3), "one").count() == 3
        assert storage.materialize(spark.range(5), "two").count() == 5
    assert len(calls) == 2

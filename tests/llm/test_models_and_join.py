import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import SCHEMA, rows
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, quality, queries, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.labelled import labelled_sample
from tidemark.llm.storage import Scratch


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    s = {i: sets(t) for i, t in docs.items()}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s[i]), find(i)) for i in ids}


def test_join_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_components({r[0]: r[1] for r in rows()})


def edited_copies(seed, n, vocab=400):
    """Documents near the threshold: copies of a few bases with growing numbers of edits, and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}"
    passage = [word() for _ in range(40)]
    out, i = {}, 0
    for size in (3, 6, 7, 12, 20, 40, 60, 64, 70, 150, 300):
        base = [word() for _ in range(size)]
        for k in range(n):
            w = list(base)
            for _ in range(k % 6):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [word()]
            if k % 4 == 3:
                w += passage
            out[i] = " ".join(w).upper() if k % 2 else "\n".join(w)
            i += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_near_the_threshold(spark, shared, seed, monkeypatch):
    docs = edited_copies(seed, 14)
    if seed == 2:  # nearly every shingle counts as common, so hot groups are split and combined
        monkeypatch.setattr(jaccard_join, "COMMON", 3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_join_large_groups_and_odd_rows(spark, shared):
    base = " ".join(f"word{i}" for i in range(100))
    near = [(i, base.replace(f"word{i % 90} ", f"other{i} ", 1)) for i in range(300)]
    odd = [(None, base), (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1003, "one two"), (1004, "ONE\tTWO")]
    df = spark.createDataFrame(near + odd, "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == 307
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 300} == {0}
    by = {r.doc_id: r.component_id for r in got}
    assert by[None] is None and by[1000] == 1000 and by[1001] == 1001 and by[1003] == 1003 and by[1004] == 1003


def test_join_of_nothing(spark, no_docs):
    assert jaccard_join.near_duplicates(no_docs).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_sketch_distance_bounds_the_difference(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard_join.hamming(jaccard_join.bit_sketch(x), jaccard_join.bit_sketch(y)) <= len(a ^ b)


@given(st.integers(0, 2**32), st.integers(1, 400), st.floats(0, 0.15))
@settings(max_examples=80, deadline=None)
def test_linked_sets_share_a_key(seed, n, part):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    drop = rng.random(len(a)) < part
    b = np.unique(np.r_[a[~drop], rng.integers(0, 2**63, int(drop.sum()), dtype=np.uint64)])
    shared = len(np.intersect1d(a, b))
    if len(b) and 100 * shared >= 75 * (len(a) + len(b) - shared):
        codes = np.zeros(jaccard_join.COUNTERS, np.uint8)
        for most in (0, n // 2, n - n // 8, n):  # so many members are common
            codes[(a[:most] >> jaccard_join._SLOT).astype(np.int64)] = 99
            keys = [dict(zip(*(x.tolist() for x in jaccard_join.cell_keys(s, codes, 50)), strict=True)) for s in (a, b)]
            both = [(keys[0][k], keys[1][k]) for k in keys[0].keys() & keys[1].keys()]
            # A rare key, or a common one that pairs the two.
            near = lambda x, y: len(b) <= jaccard_join.reach(len(a), x) and len(a) <= jaccard_join.reach(len(b), y)
            assert any(x == y == jaccard_join.ALWAYS or near(x, y) for x, y in both)


def test_components_of_chains_and_hubs(spark, shared):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 299), (298, 299)]
    got = defaultdict(set)
    with Scratch(spark, "test") as space:
        for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5), space).collect():
            got[r.component].add(r.node)
    assert got == {0: set(range(41)), 100: set(range(100, 160)), 298: {298, 299, 300}}


def labelled(n=400, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    out, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vileword", "nastyword"]))
        if bad:
            text = [w.upper() + "!!" for w in text]
        out.append((i, " ".join(text), "en", "s", 1))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    return out, labels


@pytest.fixture(scope="module")
def corpus(spark, shared):
    out, labels = labelled()
    return spark.createDataFrame(out, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), out, labels


def test_toxicity_on_held_out_documents(spark, corpus):
    docs, labels, out, lab = corpus
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    truth = {i: ("vileword" in t.lower() or "nastyword" in t.lower()) for i, t, *_ in out}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_ftrl_is_the_published_update():
    """Coordinate by coordinate, with a dictionary for each state."""
    import math

    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 12))), rng.randint(0, 1)) for _ in range(200)]
    alpha, beta, l1, l2, bias = 0.5, 1.0, 0.7, 0.1, 40
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i != bias and abs(z[i]) <= l1 or z[i] == 0:
            return 0.0
        return -(z[i] - (0 if i == bias else math.copysign(l1, z[i]))) / ((beta + math.sqrt(n[i])) / alpha + l2)

    model = toxicity.FtrlProximal(40, alpha, beta, l1, l2)
    for at, label in rows:
        p = 1 / (1 + math.exp(-sum(map(weight, [*at, bias]))))
        for i, w in [(i, weight(i)) for i in [*at, bias]]:
            g = p - label
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
        model.update(np.array([*at, bias]), label)
    assert model.weights(np.arange(41)) == pytest.approx([weight(i) for i in range(41)], abs=1e-12)
    assert (model.weights(np.arange(40)) == 0).any()


def test_toxicity_scores_by_brute_force(spark, corpus):
    """Training and scoring over again on the driver, features counted from their definition."""
    docs, labels, out, lab = corpus
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    texts = {i: t for i, t, *_ in out}
    learn = [(str(i), int(t), np.unique(toxicity.features(texts[i]))) for i, _, t in lab if zlib.crc32(str(i).encode()) % 5]
    learn.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0]))
    model, bias = toxicity.FtrlProximal(1 << toxicity.BITS), 1 << toxicity.BITS
    for _ in range(3):
        for _, label, at in learn:
            model.update(np.r_[at, bias], label)
    for i, t in texts.items():
        x = model.weights(np.r_[np.unique(toxicity.features(t)), bias]).sum()
        assert got[i] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)


def test_model_queries_with_clashing_columns(spark, sf_dir):
    """Both as queries, on tables whose extra columns are named like outputs."""
    docs = {r[0]: r[1] for r in rows()}
    scored = queries.op5_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in scored) == sorted(docs) and all(0 <= r.score <= 1 for r in scored)
    kept = queries.op10_quality_resampling(spark, sf_dir)
    assert kept.columns == ["doc_id", "log_weight", "gumbel_key"] and {r.doc_id for r in kept.collect()} <= set(docs)


def test_labelled_sample_keeps_its_bound(spark, shared):
    """A repeated id brings one row, whatever the number of its rows; odd labels and ids are left out."""
    docs = spark.createDataFrame([(7, f"text {i % 9}") for i in range(500)] + [(i, f"t{i}") for i in range(100, 160)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (100, None), (101, 5)] + [(i, i % 2) for i in range(102, 160)], "doc_id long, toxic long")
    got = labelled_sample(docs, labels, "toxic", 41, skip_held_out=False).collect()
    assert len(got) == len({r.doc_id for r in got}) == 41 and not {None, 100, 101} & {r.doc_id for r in got}
    whole = {r.doc_id: r.label for r in labelled_sample(docs, labels, "toxic", 1000, skip_held_out=False).collect()}
    assert whole == {7: 1} | {i: i % 2 for i in range(102, 160)}


def test_toxicity_ignores_held_out_labels_and_other_columns(spark, corpus):
    docs, labels, _, lab = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.train(docs, labels)
    b = toxicity.train(docs.withColumn("lang", F.lit("x")), flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert len(a[0]) < 2000  # sparse


def test_toxicity_without_labels_and_odd_rows(spark, corpus, no_docs):
    _, labels, *_ = corpus
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (None, "x y", None, None, None), (2, "", None, None, None)], SCHEMA)
    got = toxicity.classify(df, labels.where("doc_id < 0")).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert toxicity.classify(no_docs, labels).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, corpus):
    docs, labels, out, _ = corpus
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    good = {i for i, t, *_ in out if "!!" not in t}
    assert len(kept & good) >= 0.99 * len(good) and len(kept - good) <= 0.01 * len(out)


def test_quality_weights_by_brute_force(spark, corpus):
    """The target model of good labelled texts and the raw model of all texts, counted in dictionaries."""
    import math

    docs, labels, out, lab = corpus
    texts, good = {i: t for i, t, *_ in out}, {i for i, q, _ in lab if q}
    target, raw = Counter(), Counter()
    for i, t in texts.items():
        grams = quality.ngrams(t).tolist()
        raw.update(grams)
        if i in good:
            target.update(grams)
    scale = sum(target.values()) / sum(raw.values())
    weight = {i: sum(math.log((target[g] + 8) / (raw[g] * scale + 8)) for g in quality.ngrams(t).tolist()) for i, t in texts.items()}
    cut = quality.fit(docs, labels)[1]
    rows = quality.resample(docs, labels).collect()
    k = sum(w >= cut for w in weight.values())
    assert len(rows) == k and all(r.log_weight == pytest.approx(weight[r.doc_id], abs=1e-6) for r in rows)
    noise = {i: -math.log(-math.log(((xxhash.xxh3_64_intdigest(str(i), 11) >> 11) + 0.5) / 2**53)) for i in texts}
    assert {r.doc_id for r in rows} == set(sorted(texts, key=lambda i: -(weight[i] + noise[i]))[:k])


def test_quality_of_odd_rows(spark, corpus):
    """NULL and empty texts weigh 0, NULL ids are judged, equal rows are drawn together, also at the last key."""
    _, labels, *_ = corpus
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "abc !!"), (3, "abcde"), (3, "abcde")], "doc_id long, text string")
    got = quality.resample(odd, labels.where("doc_id < 0")).collect()
    assert len(got) == 5 and all(r.log_weight == 0 for r in got)
    top = max(r.gumbel_key for r in got)
    for k in range(1, 6):
        some = quality.resample(odd, labels.where("doc_id < 0"), k=k).collect()
        least = sorted((r.gumbel_key for r in got), reverse=True)[k - 1]
        assert sorted(map(str, some)) == sorted(str(r) for r in got if r.gumbel_key >= least) and max(r.gumbel_key for r in some) == top
    whole = quality.keep(odd.withColumn("log_weight", F.lit("x")), labels.where("doc_id < 0"))
    assert whole.columns == ["doc_id", "text", "log_weight"] and whole.count() == 5


def test_quality_is_gumbel_top_k(spark, corpus):
    docs, labels, *_ = corpus
    all_rows = quality.resample(docs, labels.where("quality = 1")).collect()  # no bad labels: all pass
    assert len(all_rows) == docs.count()
    top = {r.doc_id for r in quality.resample(docs, labels.where("quality = 1"), k=50).collect()}
    assert top == {r.doc_id for r in sorted(all_rows, key=lambda r: -r.gumbel_key)[:50]}
    assert quality.resample(docs, labels, k=0).count() == 0
    assert quality.resample(docs.limit(0), labels).count() == 0


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=40), st.integers(1, 40))
@settings(max_examples=8, deadline=None)
def test_kth_greatest(spark, values, k):
    k = min(k, len(values))
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert quality.kth_greatest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_best_threshold():
    assert quality.best_threshold(np.array([-5.0, -4, 1, 2]), np.array([0, 0, 1, 1])) == -1.5
    assert quality.best_threshold(np.array([1.0, 2]), np.array([1, 1])) == -np.inf


def test_quality_counts_hold_the_ngrams_of_a_few_texts():
    import tracemalloc
    from contextlib import nullcontext
    from unittest import mock

    import pyarrow as pa

    held = []

    class Rows(mock.MagicMock):
        def mapInArrow(self, f, schema):
            held.append(f)
            return mock.MagicMock()

    rows = Rows()
    rows.select.return_value = rows
    with mock.patch.object(quality, "settings", lambda spark: nullcontext(), create=True), mock.patch.object(quality.F, "sum"):
        quality._counts(rows)
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e " * 100] * 3000})
    tracemalloc.start()
    (out,) = held[0]([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All n-grams of the batch are 24 MB, twice.
    assert peak < 12e6 and sum(out.column("n").to_pylist()) == 3000 * 999


def test_queries_of_a_scratch_keep_short_plan_texts(spark, shared):
    # Columns with long names, as a plan's text lists them.
    wide = spark.range(10).select(*[F.col("id").alias(f"{'c' * 200}{k}") for k in range(20)])
    with Scratch(spark, "test") as space:
        kept = space.keep(wide, "wide")
        kept.groupBy(*kept.columns).count().collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seen = spark._jsparkSession.sharedState().statusStore().executionsList()
        texts = [seen.apply(k).physicalPlanDescription() for k in range(seen.size() - 2, seen.size())]
    assert max(map(len, texts)) < 2500
    assert spark.conf.get("spark.sql.maxPlanStringLength") != "2000"


def test_filter_words_come_packed(spark):
    words = spark.range(5000).selectExpr("id * 3 AS word", "id * 858993 AS bits")
    table = jaccard_join._table(words)
    assert len(table) == jaccard_join.FILTER_BITS // 32 and int((table > 0).sum()) == 4999
    assert all(table[k * 3] == k * 858993 for k in (1, 2, 4999)) and table[1] == 0

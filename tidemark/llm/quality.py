"""Quality selection by importance resampling.

Two bags of hashed n-grams are estimated: the target's from a bounded sample of
documents labelled good, the raw text's from all documents. The log of the
likelihood ratio of a text is its log importance weight; adding Gumbel noise and
keeping the ``k`` greatest sums samples ``k`` documents without replacement in
proportion to the weights. ``k`` is the number of documents whose weight passes
the threshold that best parts good from bad labelled documents.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import labelled_sample
from tidemark.llm.storage import Scratch, lean, materialize, settings

BUCKETS = 1 << 16
#: Texts whose n-grams are held at a time.
TEXTS = 200
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_U = np.uint64


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the words, marks and pairs of them in a text."""
    from xxhash import xxh3_64_intdigest as digest

    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(digest, tokens), _U, len(tokens))
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]) * _U(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs]) >> _U(48)).astype(np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """N-gram counts over all rows: summed per task, then by bucket; the driver gets one number a bucket."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):  # the n-grams of a few texts at a time: a worker keeps what it once took
                total += np.bincount(np.concatenate([ngrams(t) for t in b.column("text").slice(i, TEXTS).to_pylist()]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    with settings(texts.sparkSession):
        rows = texts.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 8.0) -> np.ndarray:
    """Log of each bucket's target count by the count expected from the raw model, ``prior`` added to both."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, prior: float = 8.0) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, threshold of the log weight); labels of at most ``bound`` documents are used.

    The target model is counted from the sample's good documents, the raw model
    from all of ``docs``; ``prior`` keeps n-grams that the sample happens to lack
    from weighing much. Without good labels all weights are 0; without bad ones
    every document passes.
    """
    with Scratch(docs.sparkSession, "quality") as space:
        sample = space.keep(labelled_sample(docs, labels, "quality", bound, skip_held_out=False), "labelled")
        target = _counts(sample.where("label = 1"))
        if not target.any():
            return np.zeros(BUCKETS), -np.inf
        ratio = log_ratio(target, _counts(docs), prior)
        with settings(docs.sparkSession):
            weights = _weighed(sample.selectExpr("CAST(label AS long) AS doc_id", "text"), ratio, 0).select("doc_id", "log_weight").collect()  # at most ``bound`` rows
    return ratio, best_threshold(np.array([r["log_weight"] for r in weights]), np.array([r["doc_id"] for r in weights]))


def best_threshold(w: np.ndarray, good: np.ndarray) -> float:
    """The cut with the greatest mean of the shares of good rows above it and of bad rows below it.

    Among equally good cuts the lowest, so that clean documents stay.
    """
    if not (good == 0).any() or not (good == 1).any():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    below_bad = np.r_[0, np.cumsum(good == 0)] / (good == 0).sum()
    above_good = 1 - np.r_[0, np.cumsum(good == 1)] / (good == 1).sum()
    real = np.r_[True, w[1:] != w[:-1], True]  # no cut between equal weights
    at = int(np.argmax(np.where(real, below_bad + above_good, -1)))
    if at == 0:
        return -np.inf
    return float(w[at]) if at == len(w) else float((w[at - 1] + w[at]) / 2)


def _keys(ids: list, texts: list, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weight, Gumbel key, the key as a long of the same order) of documents."""
    from xxhash import xxh3_64_intdigest as digest

    w = np.array([ratio[ngrams(t)].sum() for t in texts], float)
    u = np.array([(digest(str(i), seed) >> 11) + 0.5 for i in ids], float) / 2.0**53
    key = w - np.log(-np.log(u))
    bits = (key + 0.0).view(np.int64)
    return w, key, np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _weighed(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, ordinal): ordinal is the key as a long of the same order."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    id_type = dict(docs.dtypes)["doc_id"]

    def weigh(batches):
        import pyarrow as pa

        for b in batches:
            found = _keys(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), held.value, seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, found)], ["doc_id", "log_weight", "gumbel_key", "ordinal"])

    return docs.select("doc_id", "text").mapInArrow(lean(weigh), f"doc_id {id_type}, log_weight double, gumbel_key double, ordinal long")


def kth_greatest(rows: DataFrame, col: str, k: int) -> int | None:
    """Exact ``k``-th greatest value of a long column by four histograms of 16 bits (65,536 counts a round)."""
    if k <= 0:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        some = rows if prefix is None else rows.where(F.shiftright(col, shift + 16) == prefix)
        hist = sorted(((r["p"], r["count"]) for r in some.groupBy(F.shiftright(col, shift).alias("p")).count().collect()), reverse=True)
        for value, n in hist:
            if left <= n:
                prefix = value
                break
            left -= n
        else:
            return hist[-1][0] if shift == 0 and hist else None
    return prefix


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, seed: int) -> tuple[np.ndarray, DataFrame, int | None]:
    """(log ratios, weighed rows, the least key that is drawn)."""
    ratio, threshold = fit(docs, labels)
    rows = materialize(_weighed(docs, ratio, seed), "weights")
    if k is None:
        k = rows.where(F.col("log_weight") >= F.lit(float(threshold))).count()
    return ratio, rows, kth_greatest(rows, "ordinal", min(k, rows.count()))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """The sampled documents: (doc_id, log_weight, gumbel_key) of ``k`` rows of ``docs`` (doc_id, text).

    ``k`` None: as many as pass the fitted threshold. Rows that tie with the last
    one are all kept. NULL and empty texts weigh 0, a NULL id draws its noise like
    any other; repeated rows are drawn together, as they share id and text; an
    empty table gives no rows.
    """
    _, rows, last = _drawn(docs, labels, k, seed)
    rows = rows.where(F.lit(False)) if last is None else rows.where(F.col("ordinal") >= last)
    return rows.select("doc_id", "log_weight", "gumbel_key")


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns and whatever their ids.

    Each row's key is worked out again where the row is, so nothing is joined back.
    """
    ratio, _, last = _drawn(docs, labels, k, seed)
    if last is None:
        return docs.where(F.lit(False))
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def chosen(batches):
        import pyarrow as pa

        for b in batches:
            ordinal = _keys(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), held.value, seed)[2]
            yield b.filter(pa.array(ordinal >= last))

    return docs.mapInArrow(lean(chosen), docs.schema)

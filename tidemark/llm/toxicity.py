"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or absent: words, word pairs, pairs with one
word between, and four-letter word beginnings. FTRL gives every coordinate a
rate of its own and, by its L1 term, leaves most weights at exactly zero; what
remains is small enough to broadcast.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, labelled_sample

BITS = 20
_WORD = re.compile(r"\w+")
_U = np.uint64


def features(text: str | None) -> np.ndarray:
    """Feature numbers below ``2 ** BITS``, with repeats; never of anything but the text."""
    from xxhash import xxh3_64_intdigest as digest

    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(digest, words), _U, len(words))
    stems = np.fromiter((digest(x[:4], 7) for x in words if len(x) > 4), _U)
    shift = _U(64 - BITS)
    with np.errstate(over="ignore"):
        pairs = (w[:-1] * _U(0x9E3779B97F4A7C15) + w[1:]) * _U(0xBF58476D1CE4E5B9)
        skips = (w[:-2] * _U(0xC2B2AE3D27D4EB4F) + w[2:]) * _U(0x94D049BB133111EB)
    return (np.concatenate([w, stems, pairs, skips]) >> shift).astype(np.int64)


class FtrlProximal:
    """Per-coordinate FTRL-proximal updates of a logistic model; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, label: int) -> None:
        """``at``: distinct features and the bias."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) learned from at most ``bound`` labelled documents that are not held out.

    Features are hashed where the texts are; one task, bounded like the sample,
    runs the updates in the order of a hash. Without labelled documents the model
    is empty and scores everything 0.5; of two labels one missing, it learns the other.
    """
    sample = labelled_sample(docs, labels, "toxic", bound)

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            rows = [np.unique(features(t)).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "at"])

    def learn(batches):
        import zlib

        import pyarrow as pa

        rows = []
        for b in batches:
            rows += zip(*[b.column(c).to_pylist() for c in ("doc_id", "label", "at")], strict=True)
        rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), r))
        model, bias = FtrlProximal(1 << BITS), np.array([1 << BITS])
        for _ in range(epochs):
            for _, label, at in rows:
                model.update(np.concatenate([np.frombuffer(at, "<i4").astype(np.int64), bias]), label)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "weight"])

    hashed_rows = sample.mapInArrow(hashed, "doc_id string, label int, at binary")
    learned = hashed_rows.repartition(1).mapInArrow(learn, "at long, weight double").collect()  # at most 2 ** BITS + 1 rows, few by L1
    at = np.array([r["at"] for r in learned], np.int64)
    w = np.array([r["weight"] for r in learned])
    return at[at < 1 << BITS], w[at < 1 << BITS], float(w[at == 1 << BITS].sum())


def toxicity_scores(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, score, predicted); NULL and empty texts score the bias."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)["doc_id"]

    def score(batches):
        import pyarrow as pa

        at, w, bias = held.value
        table = np.zeros(1 << BITS)
        table[at] = w
        used = table != 0
        for b in batches:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                f = features(t)
                out[i] = bias + table[np.unique(f[used[f]])].sum()
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    NULL and empty texts score the bias; a NULL id is judged by its text and held
    out or not like the empty string; repeated rows score alike, a row each; ties at
    0.5 are predicted 1; an empty table gives no rows, and without labels all score
    0.5.
    """
    scored = toxicity_scores(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

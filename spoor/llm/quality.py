"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal updates.

A text becomes words and single punctuation marks. Words of capitals and words equal to the one
before are followed by a mark of that fact, so that n-grams carry over to unseen words. Single
words and pairs are hashed into a fixed number of features; a score is the sigmoid of a sparse dot
product.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spoor.llm.language import fold

BITS = 18
MASK = (1 << BITS) - 1
#: Fixed marks in the stream of words: capitals, repetition, any other word in its pair.
CAPITALS, REPEATED, BIAS = (crc32(x) & MASK for x in (b"<capitals>", b"<repeated>", b"<bias>"))
SPACED = {ord(c): f" {c} " for c in string.punctuation}
MEMO = 300_000
#: Longer words are not remembered, so a memo's memory is bounded.
LONG = 64
#: Labelled rows to learn from, at most; a sample by hash of doc_id.
MAX_ROWS = 5000


class Words(dict):
    """Hash of a word, with a flag above the hash bits for capitals."""

    def __missing__(self, word: str) -> int:
        h = crc32(word.lower().encode()) & MASK | (1 << BITS if len(word) > 1 and word.isupper() else 0)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Different feature numbers and their values, the bias last; the rest has unit length."""
    flagged = np.array([words[w] for w in text.translate(SPACED).split()], np.int64)
    h, capital = flagged & MASK, int((flagged >> BITS).sum())
    pair = (h[:-1] * 0x2545F491 + h[1:] * 0x9E3779B1 >> 7) & MASK
    index, n = np.unique(np.concatenate([h, pair, [CAPITALS] * capital, [REPEATED] * int((h[1:] == h[:-1]).sum())]).astype(np.int64), return_counts=True)
    index, n = index[index != BIAS], n[index != BIAS]
    value = np.sqrt(n)
    value = value / max(np.sqrt(n.sum()), 1)
    return np.append(index, BIAS), np.append(value, 0.3)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader state."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        gradient = (sigmoid(float(w @ value)) - label) * value
        sigma = (np.sqrt(self.n[index] + gradient**2) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += gradient - sigma * w  # the numbers of one text differ
        self.n[index] += gradient**2


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 2) -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold.

    At most ``max_rows`` of them, those with the smallest hash of doc_id: a random sample that does
    not depend on how the tables are stored. Rows without label, text or id teach nothing; of several
    labels of one id the lowest counts. Without any row the weights are zero.
    """
    label = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it can be broadcast

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [features(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                ["doc_id", "quality", "feature", "value"],
            )

    rows = (
        docs.where(F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "doc_id")
        .select("doc_id", "quality", "text")
        .mapInArrow(sparse, "doc_id long, quality int, feature binary, value binary")
        .orderBy("doc_id", F.xxhash64("feature", "value"))
        .limit(2 * max_rows)  # ids that repeat in documents cannot exceed the bound either; which rows stay is fixed by the order
        .collect()
    )
    rows.sort(key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.feature)))
    model = Ftrl()
    for _ in range(epochs):
        for r in rows:
            model.update(np.frombuffer(r.feature, np.int32), np.frombuffer(r.value, np.float32).astype(np.float64), r.quality)
    return model.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per document ``doc_id, score`` (0 to 1, higher: better). A null text scores as an empty one,
    by the bias alone. One row in, one row out; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = shared.value, Words()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(1)):
                index, value = features(t.as_py() or "", words)
                out[k] = sigmoid(float(w[index] @ value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; a null id is in no fold."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. One binary classifier per bit weighs the hashed byte
n-grams of a text (log-odds of the gram under the languages whose bit is 1 against the others).
Decoding adds up a logistic loss per bit, weighted by how well that bit's classifier separates its
two sides, and takes the nearest codeword; a close runner-up makes a text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

N_FEATURES = 1 << 13
N_GRAM = 3
CHUNK = 1 << 20
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Hashed 3-byte grams of the lower-cased text between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - N_FEATURES.bit_length() + 1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1. Up to seven languages: every split of the languages in two, one bit
    each. More: the best of several seeded random codes by least distance between two words."""
    if k <= 7:
        columns = [[1 if i == 0 or not (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(1, 1 << (k - 1))] if k > 1 else []
        return np.array(columns, np.int8).reshape(len(columns), k).T
    rng, best, far = np.random.default_rng(20), None, -1
    bits = 15 * int(np.ceil(np.log2(k)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code[0, np.abs(code.sum(0)) == k] *= -1  # a bit must split the languages
        least = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(k), 2))
        if least > far:
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # feature x bit
    loss_weight: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        found = grams(text)
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(found), CHUNK):
            total += np.bincount(found[at : at + CHUNK], minlength=N_FEATURES) @ self.weights if len(found) > N_FEATURES else self.weights[found[at : at + CHUNK]].sum(0)
        return total / np.sqrt(len(found))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of margins to the language number by likeness, best first, and the likeness."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) @ self.loss_weight
        like = np.exp(loss.min(1, keepdims=True) - loss)
        like /= like.sum(1, keepdims=True)
        return np.argsort(-like, axis=1, kind="stable"), like


def fit(docs: DataFrame, train: Column) -> LanguageModel:
    """Count the grams of every document for which ``train`` holds and lang is not null, by
    language; the driver gets languages x features counts, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(N_FEATURES, np.int64))[:] += np.bincount(grams(text), minlength=N_FEATURES)
        for lang, n in sums.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["lang", "feature", "n"])

    rows = (
        docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    n = np.zeros((len(languages), N_FEATURES))
    n[np.searchsorted(languages, rows["lang"]) if languages else [], rows["feature"]] = rows["n"]
    p = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights, separation = np.zeros((N_FEATURES, code.shape[1] if languages else 0)), []
    for bit in range(weights.shape[1]):
        one, other = p[code[:, bit] > 0].mean(0), p[code[:, bit] < 0].mean(0)
        weights[:, bit] = np.log(one) - np.log(other)
        separation.append(float(((one - other) * weights[:, bit]).sum()))
    loss_weight = np.array(separation) / max(sum(separation), 1e-12) * len(separation) if separation else np.zeros(0)
    return LanguageModel(languages, code, weights, loss_weight)


def predict(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.5) -> DataFrame:
    """Per document ``doc_id, lang_pred, score, runner_up, ambiguous``.

    score is the share of the nearest codeword, 0 to 1; ``ambiguous`` marks scores under
    ``ambiguous_below``. A null text and one without a letter give ``und``, score 0 and not
    ambiguous; so does every text if there was nothing to learn from. One row in, one row out,
    repeated rows and null ids included; columns other than doc_id and text play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # languages x features, whatever the corpus
        for batch in batches:
            n = batch.num_rows
            margins, known = np.zeros((n, m.weights.shape[1])), np.zeros(n, bool)
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                if text and m.languages and has_letter(text):
                    known[i] = True
                    margins[i] = m.margins(text)
            lang, second, score = [UNDETERMINED] * n, [None] * n, np.zeros(n)
            if known.any():
                order, like = m.decode(margins)
                for i in np.flatnonzero(known):
                    lang[i], score[i] = m.languages[order[i, 0]], like[i, order[i, 0]]
                    second[i] = m.languages[order[i, 1]] if len(m.languages) > 1 else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(known & (score < ambiguous_below))],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean"
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def identify(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of the documents and predict all of them; a null id is in no fold, so
    its text is neither learnt from nor held out."""
    model = fit(docs, fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told: not ``und`` and not ambiguous. The decision is
    taken in the same task as the text, so nothing is shuffled and repeated ids do not matter."""
    model = fit(docs, fold(F.col("doc_id"), 3) != 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # languages x features, whatever the corpus
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, value in enumerate(batch.column(batch.schema.get_field_index("text"))):
                text = value.as_py()
                if text and m.languages and has_letter(text):
                    order, like = m.decode(m.margins(text)[None, :])
                    keep[i] = like[0, order[0, 0]] >= 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

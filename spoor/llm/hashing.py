"""Hashes of words and word runs, for whole blocks of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
MEMO = 300_000
#: Longer words are not remembered, so a memo's memory is bounded.
LONG = 64
FAMILIES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC4CEB9FE1A85EC53))


class WordHashes(dict):
    """64-bit hash of a word; a memo that is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], np.uint64)


def mix(a: np.ndarray, b: np.ndarray | int, family: int = 0) -> np.ndarray:
    """A hash of two hashes, in this order."""
    c1, c2, c3 = map(np.uint64, FAMILIES[family])
    with np.errstate(over="ignore"):
        x = a * c1 + (np.asarray(b, np.uint64) ^ c3) * c2
        x ^= x >> np.uint64(29)
        x *= c3
    return x ^ (x >> np.uint64(32))


def runs(h: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` items, by doubling: of n items n - length + 1 runs."""
    done, out = 1, mix(h, length, family)
    while done < length:
        step = min(done, length - done)
        out = mix(out[:-step] if step else out, out[step:], family)
        done += step
    return out


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into pieces of about BLOCK characters of text, null texts as empty ones."""
    for batch in batches:
        texts, start, room = [], 0, 0
        for k, value in enumerate(batch.column(text_at)):
            texts.append(value.as_py() or "")
            room += len(texts[-1])
            if room >= BLOCK:
                yield batch.slice(start, k + 1 - start), texts
                texts, start, room = [], k + 1, 0
        if texts:
            yield batch.slice(start), texts

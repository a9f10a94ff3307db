"""Quality rules with suffix-array repetition.

The words of each text get a suffix array (prefix doubling, only suffixes that are not yet unique
are sorted again) and the common prefixes of its neighbours. A suffix's longest repeat is the larger
of its two; the intervals of equal common prefixes are the maximal repeated substrings, and the
union of their spans is the repeated part of the text. Texts are worked through in blocks of about
a megabyte, one suffix array a block, in which every text has word numbers of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
BEYOND = np.iinfo(np.int32).max


class RangeMinimum:
    """Smallest value of any range of an array: minima of strips of STRIP places, and of 2^k strips in a row."""

    STRIP = 32

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // self.STRIP)
        padded = np.full(n * self.STRIP, BEYOND, np.int32)
        padded[: len(values)] = values
        self.values, self.strips = values, [padded.reshape(n, self.STRIP).min(1)]
        while 2 * (step := 1 << len(self.strips) - 1) <= n:
            last = self.strips[-1]
            self.strips.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low to high, both included."""
        out = np.full(len(low), BEYOND, np.int32)
        first, last = low // self.STRIP, high // self.STRIP
        for t in range(self.STRIP):
            for at, strip in ((low + t, first), (high - t, last)):
                inside = (at >= low) & (at <= high) & (at // self.STRIP == strip)
                out[inside] = np.minimum(out[inside], self.values[at[inside]])
        whole = np.flatnonzero(last - first > 1)
        if len(whole):
            a, b = first[whole] + 1, last[whole]
            level = np.frexp(b - a)[1] - 1
            for k in np.unique(level):
                on = level == k
                strips, here = self.strips[k], whole[on]
                out[here] = np.minimum(out[here], np.minimum(strips[a[on]], strips[b[on] - (1 << k)]))
        return out


def longest_repeats(word: np.ndarray) -> np.ndarray:
    """Per position the length of the longest run of words from it that starts elsewhere too.

    Two neighbours of the suffix array part in the round in which their first 2 x step words differ: they have step
    words in common and then as many as the suffixes behind those, which parted before. Kept are the suffix array, the ranks
    and the common prefixes, 4 bytes a word each, and in a round what is not yet unique.
    """
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable").astype(np.int32)  # the suffix array so far
    ordered = word[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    del ordered
    common = np.where(new, 0, BEYOND).astype(np.int32)  # with the neighbour before; BEYOND: not parted yet
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n + 1, np.int32)
    rank[n], rank[order] = -1, head
    place = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in the suffix array whose suffix is not unique
    del head, new
    step = 1
    while len(place):
        at = order[place]
        first, then = rank[at], rank[np.minimum(at + step, n)]
        by = np.lexsort((then, first))
        at, first, then = at[by], first[by], then[by]
        new_first = np.r_[True, first[1:] != first[:-1]]
        new_pair = new_first | np.r_[True, then[1:] != then[:-1]]
        order[place] = at
        parted = np.flatnonzero(new_pair & ~new_first)
        if len(parted):
            common[place[parted]] = step + np.where(then[parted - 1] < 0, 0, RangeMinimum(common).of(then[parted - 1].astype(np.int64) + 1, then[parted].astype(np.int64)))
        rank[at] = place[np.maximum.accumulate(np.where(new_pair, np.arange(len(at)), 0))]
        step *= 2
        place = place[~(new_pair & np.r_[new_pair[1:], True])]
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], np.int32(0)])
    return longest


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str], least_words: int) -> list[tuple]:
    """Per text: words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered characters of
    repeats of ``least_words`` and more, words of the longest repeat."""
    numbers, lengths, bounds, base = [], [], [0], 0
    out = []
    for t in texts:
        words = t.encode().split()
        own: dict[bytes, int] = {}
        numbers += [base + own.setdefault(w, len(own)) for w in words]
        numbers.append(base + len(own))  # ends the text
        base += len(own) + 1
        lengths += map(len, words)
        lengths.append(0)
        bounds.append(len(numbers))
        lines = [x for x in t.split("\n") if x and not x.isspace() or x.strip(SPACES)] if "\n" in t else [t]
        out.append((len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines))))
    word, length = np.array(numbers, np.int64), np.array(lengths, np.int64)
    longest, n = longest_repeats(word), len(numbers)
    triple = covered(np.flatnonzero(longest >= 3), 3, n)
    start = np.flatnonzero(longest >= least_words)
    part = covered(start, longest[start], n)
    in_triple, in_part, top = np.r_[0, np.cumsum(triple)], np.r_[0, np.cumsum(part * length)], np.r_[0, np.cumsum(length)]
    return [
        (*o, int(in_triple[b] - in_triple[a]), int(in_part[b] - in_part[a]), int(top[b] - top[a]), int(longest[a:b].max(initial=0)))
        for o, a, b in zip(out, bounds, bounds[1:], strict=False)
    ]


def rules(docs: DataFrame, least_words: int = 8, max_covered: float = 0.4, max_longest: int = 120) -> DataFrame:
    """Per document ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, repeat_fraction, longest_repeat, kept``.

    base_failed: under 50 words, or over half of the words in 3-word windows found twice or more.
    kept: not base_failed, and the repeats of ``least_words`` words and more cover at most
    ``max_covered`` of the word bytes, the longest having at most ``max_longest`` words. A null text
    counts as empty and is not kept. One row in, one row out; only doc_id and text are read. A text is taken as a
    whole: a very long one needs about 150 bytes of memory a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, room = [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append(value.as_py() or "")
                ids.append(doc_id)
                room += len(texts[-1])
                if room >= BLOCK:
                    yield rows(ids, texts)
                    texts, ids, room = [], [], 0
            if texts:
                yield rows(ids, texts)

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        made = []
        for i, (n, chars, symbols, dup, repeat, part, whole, longest) in zip(ids, measure(texts, least_words), strict=True):
            failed = n < 50 or 100 * repeat > 50 * n
            fraction = part / whole if whole else 0.0
            made.append((i, n, chars, symbols, dup, repeat, failed, fraction, longest, not failed and fraction <= max_covered and longest <= max_longest))
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, ", ".join(f"{c} {k}" for c, k in zip(NAMES, ["long"] * 6 + ["boolean", "double", "long", "boolean"], strict=True))
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "repeat_fraction", "longest_repeat", "kept"]

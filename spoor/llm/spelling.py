"""Grouping of spelling variants with a dictionary of pairs of trie nodes.

The words are sorted by range once as they are and once reversed. In sorted order the words that share a prefix are
neighbours, so each prefix (a node of the trie) gets its number from the first word that has it: the letters before that word
in the order, plus its own length. A word cut at a place is then a pair of integers, the node of what is before and the
reversed trie's node of what is behind. Leaving out one letter at the cut gives a pair as well. Two words that share such a pair
differ in that letter only; a word's whole pair equal to another's pair with a letter left out means one letter
more. Numbers are exact, so no candidate has to be verified, and a pair's group has at most one word for each letter of the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spoor.llm.common import materialize, n_partitions
from spoor.scratch import discard

#: Words of one range, about; a range is numbered in one task.
RANGE_WORDS = 100_000
#: Characters of a text that are taken apart at once, and different words counted before they are handed on.
STRETCH, HELD = 1 << 20, 200_000
LETTER = "A-Za-zÀ-ÿ"


def _stretches(text: str) -> Iterator[str]:
    """The text in pieces that end where a run of letters ends."""
    start, end_of_run = 0, re.compile(f"[^{LETTER}]")
    while len(text) - start > STRETCH:
        end = end_of_run.search(text, start + STRETCH)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:] if start else text


def misspelt(docs: DataFrame, every: int = 97, least: int = 5) -> DataFrame:
    """``word, n``: the runs of letters of all texts, of which a checksum of document and run cuts one letter from every
    ``every``-th, if they have ``least`` letters at least, and how often they occur. Rows of one word can be several."""
    runs_of = re.compile(f"[{LETTER}]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                own = "" if doc_id.as_py() is None else str(doc_id.as_py())
                start = zlib.crc32(f"{own}:".encode())
                for part in _stretches(text.as_py()):
                    # Only A-Z become small: the bytes of other letters are all over 127.
                    for word, n in Counter(runs_of(part.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _edges(part: int, keys: list[str]) -> tuple:
    """Of a range of sorted words: number, first and last word, letters with one more for each word, and the last word's path:
    from which depth on which word's numbers count."""
    base, path, before = 0, [(0, 0)], keys[0]
    for key in keys:
        shared = common_prefix(before, key)
        if before is not key:
            path = [p for p in path if p[0] <= shared] + [(shared + 1, base)]
        base, before = base + len(key) + 1, key
    return part, keys[0], before, base, [list(p) for p in path]


def node_numbers(words: DataFrame, reverse: bool, parts: int) -> DataFrame:
    """``word, base, path, last``: the number of the node of every prefix of the word, the empty one first; reversed, of every suffix, from the
    shortest on. base: the number of letters of all words before it and one for each, increasing with the word. last: of each letter (of the
    reversed word if so), whether another follows that is not the same.

    Each range tells the driver its first and last word and a path, from which follows what the ranges
    behind it have to go on with. That is one row a range.
    """
    spark = words.sparkSession
    key = F.reverse("word") if reverse else F.col("word")
    sorted_ = words.select("word", key.alias("k")).repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    sorted_ = materialize(sorted_, "spelling-sorted")

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_edges(int(rows["part"].iloc[0]), sorted(rows["k"]))], columns=["part", "first", "last", "letters", "path"])

    schema = "part int, first string, last string, letters long, path array<array<long>>"
    ranges = sorted(sorted_.groupBy("part").applyInPandas(edges, schema).collect(), key=lambda r: r["part"])
    starts, base, path, last = [], 0, [], None
    for r in ranges:
        shared = -1 if last is None else common_prefix(last, r["first"])
        going_on = [p for p in path if p[0] <= shared]
        starts.append((r["part"], base, shared, going_on))
        own = min(shared, common_prefix(r["first"], r["last"]))  # up to here the path comes from ranges before
        path = [p for p in going_on if p[0] <= own]
        path += [(max(depth, own + 1), base + at) for k, (depth, at) in enumerate(r["path"]) if k + 1 == len(r["path"]) or r["path"][k + 1][0] > own + 1]
        base, last = base + r["letters"], r["last"]
    begins = spark.createDataFrame(starts, "part int, start long, shared int, going_on array<array<long>>")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        base, shared, steps = int(first["start"]), int(first["shared"]), [list(map(int, p)) for p in first["going_on"]]
        path: list[int] = []
        for k, (depth, at) in enumerate(steps):
            end = steps[k + 1][0] if k + 1 < len(steps) else shared + 1
            path += range(at + depth, at + end)
        out, before = [], None
        for word in sorted(rows["k"]):
            if before is not None:
                shared = common_prefix(before, word)
            path = path[: shared + 1] + list(range(base + shared + 1, base + len(word) + 1))
            out.append((word[::-1] if reverse else word, base, np.array(path, np.int64), np.array([a != b for a, b in zip(word, word[1:] + " ", strict=True)], bool)))
            base, before = base + len(word) + 1, word
        return pd.DataFrame(out, columns=["word", "base", "path", "last"])

    numbered = sorted_.join(begins, "part").groupBy("part").applyInPandas(number, "word string, base long, path array<long>, last array<boolean>")
    out = materialize(numbered, "spelling-nodes")
    discard(spark, sorted_.scratch_path)
    return out


def pairs(words: DataFrame, ahead: DataFrame, behind: DataFrame) -> DataFrame:
    """``before, behind, whole, last, id, n`` of every word: for each place its pair of nodes with nothing left out (``whole``) and
    with the letter at the place left out. last: the letter is the last of a run of equal ones; leaving out another of that run would
    give the same word. ahead, behind: the words' nodes as from ``node_numbers``."""
    both = words.join(ahead, "word").join(behind.select("word", F.reverse("path").alias("suffixes")), "word").withColumn("length", F.size("path") - 1)
    skips = F.arrays_zip(F.slice("path", F.lit(1), F.col("length")).alias("before"), F.slice("suffixes", F.lit(2), F.col("length")).alias("behind"), "last")
    skips = F.transform(skips, lambda x: F.struct(x["before"].alias("before"), x["behind"].alias("behind"), F.lit(False).alias("whole"), x["last"].alias("last")))
    wholes = F.transform(F.arrays_zip(F.col("path").alias("before"), F.col("suffixes").alias("behind")), lambda x: F.struct(x["before"].alias("before"), x["behind"].alias("behind"), F.lit(True).alias("whole"), F.lit(False).alias("last")))
    return both.select(F.explode(F.concat(skips, wholes)).alias("p"), F.col("base").alias("id"), "n").select("p.*", "id", "n")


def neighbours(rows: DataFrame) -> DataFrame:
    """``id, n_near, best`` from the ``pairs``: of each word the number of words one letter away, and of them that of largest n, of equal ones the first in
    order (as ``(-n, id)``), unless the word itself is as frequent as any.

    A pair's group holds at most one whole word, and words with a letter left out only for the letters there are; it is never listed
    pair by pair, only counted and its most frequent word taken.
    """
    group = Window.partitionBy("before", "behind")
    own = F.struct((-F.col("n")).alias("minus"), F.col("id").alias("id"))
    skip = ~F.col("whole")
    rows = rows.select(
        "id",
        "whole",
        "last",
        own.alias("own"),
        F.count(F.when(skip, 1)).over(group).alias("skips"),
        F.count(F.when(F.col("last"), 1)).over(group).alias("lasts"),
        F.count(F.when(F.col("whole"), 1)).over(group).alias("wholes"),
        F.min(F.when(skip, own)).over(group).alias("of_skips"),
        F.min(F.when(F.col("last"), own)).over(group).alias("of_lasts"),
        F.min(F.when(F.col("whole"), own)).over(group).alias("of_whole"),
    ).where("skips + wholes > 1")
    near = F.when(F.col("whole"), F.col("lasts")).otherwise(F.col("skips") - 1 + F.when(F.col("last"), F.col("wholes")).otherwise(0))
    # If the word itself leads its group, no other there is twice as frequent.
    other = F.when(F.col("of_skips.id") != F.col("id"), F.col("of_skips"))
    best = F.when(F.col("whole"), F.col("of_lasts")).otherwise(F.least(other, F.when(F.col("last"), F.col("of_whole"))))
    return rows.groupBy("id").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root``: where following ``id, form`` from word to word ends. Every round doubles the steps taken; frequencies at least double
    with each step, so five rounds or six are the most there can be."""
    ways = materialize(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = ways.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = materialize(ways.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not longer.where("moved").isEmpty()
        discard(ways.sparkSession, ways.scratch_path)
        ways = longer
        if not moved:
            return ways.select("id", "root")


def variants(docs: DataFrame, least: int = 5, at_least: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """Per word ``word, form, root, n, n_near, form_n``.

    A word has ``least`` letters and ``at_least`` occurrences; see ``misspelt``. n_near: words that differ by exactly one letter more,
    less or other. form: of these the most frequent (of equal ones the first in code-point order), if it occurs ``times`` times as often; root:
    the last of the chain of forms, the word itself if it has none. ``times`` must be over 1.

    Null texts have no words; a null doc_id counts as an empty one; rows that repeat count each; other columns
    are left out. Without words the result is empty.
    """
    spark = docs.sparkSession
    words = misspelt(docs, every, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    words = materialize(words, "spelling-words")
    total = words.count()
    parts = max(n_partitions(spark), -(-total // RANGE_WORDS))
    ahead, behind = (node_numbers(words, reverse, parts) for reverse in (False, True))
    near = materialize(neighbours(pairs(words, ahead, behind)), "spelling-near")
    named = materialize(words.join(ahead.select("word", F.col("base").alias("id")), "word"), "spelling-ids")
    forms = near.where(F.col("best").isNotNull()).select("id", F.col("best.id").alias("form"), (-F.col("best.minus")).alias("form_n"))
    forms = forms.join(named.select("id", "n"), "id").where(F.col("form_n") >= times * F.col("n")).drop("n")
    forms = materialize(forms, "spelling-forms")
    ends = roots(forms)
    text = lambda of: named.select(F.col("id").alias(f"{of}_id"), F.col("word").alias(of))
    found = forms.join(ends, "id").select("id", F.col("form").alias("form_id"), "form_n", F.col("root").alias("root_id"))
    found = found.join(text("form"), "form_id").join(text("root"), "root_id").select("id", "form", "form_n", "root")
    rows = named.join(near.select("id", "n_near"), "id", "left").join(found, "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))

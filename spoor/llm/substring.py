"""Removal of repeated passages with a log-structured index of fingerprints.

A window is a run of words. Its anchor is the smallest of the hashes of the shorter runs in it, so
equal windows have equal anchors, and the windows of a document fall into segments of neighbours with one
anchor. The index holds a row per anchor and content of a segment, with a count and the place of one: sorted, immutable runs, one
per batch of documents. Each new batch is merge-joined with the runs that are there, decided, and then added; runs are compacted like the
levels of a log-structured store. A segment whose content occurs twice repeats as a whole. Where an anchor
occurs in different contents, its windows are verified one by one by a 128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spoor.llm.common import n_partitions
from spoor.llm.hashing import WordHashes, blocks, mix, runs
from spoor.llm.sieve import Sieve, held, key_of
from spoor.scratch import discard, materialize, shared_dir

WINDOW = 35
ANCHOR = 12
KEY = ["doc_id", "tie"]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, text``: the id and a hash of the text name a document; rows with both equal are alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))


def cut(words: list[int], h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of a block of documents: document, first window (in its document), number of
    windows, anchor hash, content hash. words: the number of words of each document."""
    ends = np.cumsum(words)
    doc = np.repeat(np.arange(len(words)), words)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    value = runs(h, anchor)
    place = np.arange(len(value))
    reach, best, at = window - anchor + 1, value, place
    done = 1
    while done < reach:  # leftmost smallest hash of each window, by doubling
        step = min(done, reach - done)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        done += step
    inside = doc[:n] == doc[window - 1 :]
    own = runs(h, window)
    start = np.flatnonzero(inside)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at, own = at[start], own[start]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])]
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, len(start)])
    number = np.arange(len(start)) - np.repeat(first, size)
    content = mix(np.add.reduceat(mix(own, number, 1), first), size, 1)
    of = doc[start[first]]
    return of, start[first] - (ends - words)[of], size, value[at[first]], content


def segments(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, tie, start, size, anchor, content`` of every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in blocks(batches, 2):
            split = [t.encode().split() for t in texts]
            sizes = np.array([len(w) for w in split])
            h = hashes.of([w for words in split for w in words])
            of, start, size, a, c = cut(sizes, h, window, anchor)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))],
                ["doc_id", "tie", "start", "size", "anchor", "content"],
            )

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, start int, size int, anchor long, content long")


PLACE = ["doc_id", "tie", "start", "size"]


@contextmanager
def _by_anchor(spark: SparkSession) -> Iterator[None]:
    """Tables that lie by anchor join on anchor and content where they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FingerprintIndex:
    """Sorted immutable runs of (anchor, content, n, place of one segment), kept as tables bucketed by anchor so that runs
    merge-join without a shuffle.

    ``add`` writes the fingerprints of a batch as a run of level 0; two runs of a level are compacted into
    one of the next. ``compact`` merges all. Runs that were merged are dropped. ``saved`` tells all that another session
    needs to go on with the index, by ``reopen``; ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or n_partitions(spark)
        self.levels: list[tuple[int, str]] = []

    def saved(self) -> dict:
        return {"buckets": self.buckets, "runs": [[level, f"{shared_dir(self.spark)}/{name}"] for level, name in self.levels]}

    @classmethod
    def reopen(cls, spark: SparkSession, saved: dict) -> FingerprintIndex:
        """The index that ``saved`` described. Its runs are named in this session's catalog anew, where they lie."""
        index = cls(spark, saved["buckets"])
        for level, path in saved["runs"]:
            name = path.rsplit("/", 1)[1]
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, content BIGINT, n BIGINT, doc_id BIGINT, tie BIGINT, start INT, size INT) USING parquet LOCATION '{path}' "
                f"CLUSTERED BY (anchor) SORTED BY (anchor, content) INTO {index.buckets} BUCKETS"
            )
            index.levels.append((level, name))
        return index

    def drop(self) -> None:
        for _, name in self.levels:
            self._remove(name)
        self.levels = []

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, f"{shared_dir(self.spark)}/{name}")

    def run_of(self, segments: DataFrame) -> str:
        """A batch of segments as a run, not yet part of the index: counted before they are shuffled."""
        # Any place will do; the first ones all come from one row and need no sorting.
        counted = segments.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in PLACE])
        # Counted rows lie by anchor and content: a task would write a file for every bucket, the square of the partitions in all.
        return self._write(counted.repartition(self.buckets, "anchor"))

    def add(self, run: str) -> None:
        self.levels.append((0, run))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge_last()

    def compact(self) -> DataFrame:
        while len(self.levels) > 1:
            self._merge_last()
        return self.spark.table(self.levels[0][1])

    def meet(self, run: str) -> DataFrame:
        """What a new run and the index have to do with each other: ``anchor, content, new, old`` (how often in the run and in the index),
        ``contents`` (of the anchor) and the place of one segment, an old one if there is any; of every anchor of the run that
        occurs twice, in the run, in the index or between them. Written, by one merge-join with each run."""
        rows = self.spark.table(run).withColumnsRenamed({"n": "new"}).withColumn("old", F.lit(0).cast("long"))
        with _by_anchor(self.spark):
            for _, name in self.levels:
                old = self.spark.table(name).select("anchor", "content", F.col("n").alias("more"), F.struct(*PLACE).alias("p"))
                rows = rows.join(old.hint("merge"), ["anchor", "content"], "full")
                rows = rows.select("anchor", "content", F.coalesce("new", F.lit(0)).alias("new"), (F.coalesce("old", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("old"), *[F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in PLACE])
            by = Window.partitionBy("anchor")
            rows = rows.withColumns({"fresh": F.sum("new").over(by), "total": F.sum(F.col("new") + F.col("old")).over(by), "contents": F.count(F.lit(1)).over(by)})
            return materialize(rows.where("fresh > 0 and total > 1").drop("fresh", "total"), "index-met")

    def _merge_last(self) -> None:
        (_, newer), (level, older) = self.levels.pop(), self.levels.pop()
        b = self.spark.table(newer).select("anchor", "content", F.col("n").alias("more"), F.struct(*PLACE).alias("p"))
        rows = self.spark.table(older).join(b.hint("merge"), ["anchor", "content"], "full")
        rows = rows.select("anchor", "content", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), *[F.when(F.col("n").isNull(), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in PLACE])
        with _by_anchor(self.spark):
            self.levels.append((level + 1, self._write(rows)))
        for name in (newer, older):
            self._remove(name)

    def _write(self, run: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, "anchor").sortBy("anchor", "content").option("compression", "zstd")
        writer.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name, format="parquet")
        return name


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """128-bit hashes of the wanted windows: ``wanted`` has per document a list of (start, size, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k in range(batch.num_rows):
                h = hashes.of((batch.column(2)[k].as_py() or "").encode().split())
                spans = batch.column(3)[k].as_py()
                one, two = runs(h, window, 0), runs(h, window, 1)
                at = np.concatenate([np.arange(s["start"], s["start"] + s["size"]) for s in spans])
                is_open = np.repeat([s["open"] for s in spans], [s["size"] for s in spans])
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * m, pa.int64()), pa.array([batch.column(1)[k].as_py()] * m, pa.int64()), pa.array(at.astype(np.int32)), pa.array(is_open), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64))],
                    ["doc_id", "tie", "start", "open", "one", "two"],
                )

    w = wanted.select(F.col("doc_id").alias("w_doc_id"), F.col("tie").alias("w_tie"), "spans")
    docs = Sieve(wanted.select(key_of().alias("k")), "k").keep(docs.withColumn("k", key_of()), "k")
    rows = docs.join(w.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(w["w_doc_id"]) & (docs["tie"] == w["w_tie"]))
    return rows.select("doc_id", "tie", "text", "spans").mapInArrow(run, "doc_id long, tie long, start int, open boolean, one long, two long")


def repeats_with(index: FingerprintIndex, batch: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, tie, start, size`` of the windows that repeat because of a new batch, in it and in older documents, and the batch added to the
    index. ``batch``: its ``segments``; ``docs`` (as from ``keyed``): the batch's texts and all older ones.

    A content that the batch brings again, or twice, repeats as a whole; the one older segment of a content that was unique until now is
    named by its run. Where an anchor occurs in different contents, of which some are new, one segment stands for each, and their windows
    are verified one by one on the words. Windows that were found in earlier batches can come again.
    """
    spark = index.spark
    run = index.run_of(batch)
    met = index.meet(run)
    index.add(run)
    again = met.where("new > 0 and new + old > 1").select("anchor", "content", F.xxhash64("anchor", "content").alias("k"))
    whole = Sieve(again, "k").keep(batch.withColumn("k", F.xxhash64("anchor", "content")), "k").drop("k").join(again.drop("k"), ["anchor", "content"]).select(*PLACE)
    first = met.where("new > 0 and old = 1").select(*PLACE)  # where it lay until now

    stand = met.where("contents > 1").select(*PLACE, (F.col("new") + F.col("old") == 1).alias("open"))
    wanted = stand.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "size", "open")).alias("spans"))
    wanted = materialize(wanted, "windows-wanted")
    single = materialize(_windows(docs, wanted, window), "windows")
    place = F.struct("doc_id", "tie", "start")
    twice = single.groupBy("one", "two").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("one", "two")
    open_hits = single.where("open").join(twice, ["one", "two"]).select("doc_id", "tie", "start", F.lit(1).alias("size"))
    out = materialize(whole.unionByName(first).unionByName(open_hits).distinct(), "repeats-of-batch")
    for table in (met, wanted, single):
        discard(spark, table.scratch_path)
    return out


def repeats(docs: DataFrame, batches: int = 3, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, tie, spans``: of every document with repeated windows the list of (start, size) of
    them. docs as from ``keyed``. The documents enter the index in ``batches`` batches by hash; each is decided when it enters."""
    spark = docs.sparkSession
    found = materialize(segments(docs, window, anchor), "segments")
    index = FingerprintIndex(spark)
    batch = F.pmod(F.xxhash64("tie", "doc_id"), F.lit(batches))
    spans = None
    for b in range(batches):
        own = repeats_with(index, found.where(batch == b), docs, window)
        spans = own if spans is None else spans.unionByName(own)
    index.drop()
    discard(spark, found.scratch_path)
    return spans.distinct().groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def remove_repeats(docs: DataFrame, batches: int = 3, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, the kept text.

    Every word that a repeated window covers is removed, wherever else the window starts, its own
    document included. A null text has no words; texts shorter than the window lose nothing. Rows
    that repeat repeat each other: all their windows go. An empty table gives an empty one.
    """
    docs = keyed(docs)
    spans = materialize(repeats(docs, batches, window, anchor), "repeats")
    s = spans.select(F.col("doc_id").alias("s_doc_id"), F.col("tie").alias("s_tie"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, 1):
            rows = []
            for text, marked in zip(texts, part.column(2), strict=True):
                words = text.encode().split()
                if marked.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    list_of = marked.values
                    start, size = (list_of.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode()))
            n, removed, sha, left = zip(*rows, strict=True)
            arrays, names = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(left, pa.string())] if keep_text else arrays, [*names, "kept"] if keep_text else names)

    # Only texts that may have something to remove are shuffled.
    sieve = Sieve(spans.select(key_of().alias("k")), "k")
    shared, marked = sieve.shared, docs.withColumn("k", key_of())
    hit = sieve.keep(marked, "k")
    rows = hit.join(s.hint("shuffle_hash"), hit["doc_id"].eqNullSafe(s["s_doc_id"]) & (hit["tie"] == s["s_tie"]), "left").select("doc_id", "text", "spans")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other texts, told and taken apart by one worker: a filter of its own would take another's memory."""
        for batch in batches:
            keep = ~held(shared.value, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield from run(iter([batch.filter(pa.array(keep)).select([0, 1, 2])]))

    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    rest = marked.select("doc_id", "text", none, *[p.alias(f"p{i}") for i, p in enumerate(sieve.places("k"))])
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return rows.mapInArrow(run, schema).unionByName(rest.mapInArrow(untouched, schema))

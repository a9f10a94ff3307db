"""Packing of documents into sequences with a fixed mixture of sources.

Each source is a queue of tokens, its documents in the order of the table. Deficit round-robin goes over the queues: in every
window a source's deficit grows by its quantum, its share of the window, and it hands on as many whole tokens as the
deficit holds; the rest is carried to the next window. So the tokens that a source has handed on after w windows are the whole part of w
quanta, and every task knows from the source's totals in the partitions before it at which window, and with which
deficit, its own tokens begin. Documents are cut where the deficit ends. The windows' tokens form one stream, which is cut
into sequences; what is left at its end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spoor.llm.bpe import Codec, read_vocabulary
from spoor.llm.common import materialize

LENGTH = 1024
#: Tokens of a window: 64 sequences.
WINDOW = 64 * LENGTH
END = 0
#: Windows whose totals are added up in one task.
BLOCK = 1 << 14
#: Chunks that a task remembers, about 200 bytes each, and the longest of them.
MEMO, LONG = 1_000_000, 64
#: Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the pre-tokenizer always cuts: before the one space ahead of a word, and around white space.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def encoder(codec: Codec) -> Callable[[str], list[int]]:
    """The ids of a text without special tokens. Where a vocabulary numbers its merges in their order, as the public ones do, the numbers alone
    tell the order, and a library does it; else the codec."""
    if any(a >= b for a, b in pairwise(codec.made)):
        return codec.encode_ordinary
    ranks = {codec.bytes_of[i]: i for i in codec.vocabulary["vocab"].values() if i not in codec.special.values()}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Chunks(dict):
    """The ids of chunks of text met so far, as bytes of unsigned 32-bit numbers; emptied when full."""

    def __init__(self, codec: Codec):
        self.codec, self.encode_chunk = codec, encoder(codec)

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode_chunk(chunk), "<u4").tobytes()
        if len(chunk) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        special = self.codec.special
        if special and any(s in text for s in special):
            parts = self.codec.special_split.split(text)
            return b"".join([np.array([special[p]], "<u4").tobytes() if p in special else self.encode_ordinary(p) for p in parts])
        return self.encode_ordinary(text)

    def encode_ordinary(self, text: str) -> bytes:
        return b"".join([self[c] for c in CHUNK(text)])


def tokenized(docs: DataFrame, vocabulary_path: str, end: int = END) -> DataFrame:
    """``part, seq, doc_id, source, n, ahead, ids``: the ids of each text with ``end`` behind them, their number, the task and row
    that made them, and how many tokens of the same source that task met before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary_path))  # one vocabulary: a fixed size
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # lives as long as the worker, and the memo in it
        chunks = own.get("chunks") or own.setdefault("chunks", Chunks(Codec({k: own[k] for k in ("vocab", "merges", "special")}).build()))
        part, seq, ahead = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, n, before = [], [], []
                for source, text in zip(piece.column(1).to_pylist(), piece.column(2), strict=True):
                    ids.append(chunks.encode(text.as_py() or "") + last)
                    n.append(len(ids[-1]) // 4)
                    before.append(ahead.get(source, 0))
                    ahead[source] = before[-1] + n[-1]
                k = len(n)
                arrays = [pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), piece.column(0), piece.column(1), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "seq", "doc_id", "source", "n", "ahead", "ids"])
                seq += k

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "part int, seq long, doc_id long, source string, n long, ahead long, ids binary")


def queues(tokens: DataFrame, weights: dict[str | None, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``source, weight, weights`` (its weight and that of all), and ``part, source, start`` (tokens of the source before the partition).

    weights: target proportions by source, whole numbers; a source that is not named has weight 1. None: every source weighs what it
    has, so that all queues end together and every window has the corpus's own mixture.
    """
    of_part = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-parts")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = of_part.select("part", "source", F.coalesce(before, F.lit(0)).alias("start"))
    totals = of_part.groupBy("source").agg(F.sum("n").alias("weight"))
    if weights is not None:
        weight = F.lit(1)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(int(w))).otherwise(weight)
        totals = totals.select("source", weight.cast("long").alias("weight"))
    return totals.crossJoin(totals.agg(F.sum("weight").alias("weights"))), starts


def shares(tokens: DataFrame, window: int = WINDOW, weights: dict[str | None, int] | None = None) -> DataFrame:
    """``part, seq, source, place, window, start, length`` for each part of a document that one window takes: ``start`` in the document,
    ``place`` in its source's queue."""
    totals, starts = queues(tokens, weights)
    a, b = totals.select(F.col("source").alias("s"), "weight", "weights"), starts.select(F.col("source").alias("t"), F.col("part").alias("p"), F.col("start").alias("begin"))
    rows = tokens.select("part", "seq", "source", "n", "ahead")
    rows = rows.join(b, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("t"))).join(a, F.col("source").eqNullSafe(F.col("s")))
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two fit 38 digits
    quantum = whole(F.lit(window)) * whole(F.col("weight"))
    # Window w begins at place floor(w x quantum / weights); the last that begins at or before a place follows from that.
    window_of = lambda place: F.call_function("div", whole(place + 1) * whole(F.col("weights")) - 1, quantum)
    begins = lambda w: F.call_function("div", whole(w) * quantum.cast("decimal(19,0)"), whole(F.col("weights"))).cast("long")
    rows = rows.withColumn("place", F.col("begin") + F.col("ahead"))
    rows = rows.withColumn("window", F.explode(F.sequence(window_of(F.col("place")), window_of(F.col("place") + F.col("n") - 1))))
    first = F.greatest(F.col("place"), begins(F.col("window")))
    last = F.least(F.col("place") + F.col("n"), begins(F.col("window") + 1))
    rows = rows.select("part", "seq", "source", first.alias("from"), "window", (first - F.col("place")).alias("start"), (last - first).alias("length"))
    return rows.where("length > 0").withColumnRenamed("from", "place")


def stream_places(parts: DataFrame) -> DataFrame:
    """The rows of ``shares`` with ``at``, their place in the stream: window by window, in each source by source, in queue order. A window is
    one group of bounded size; the windows' totals are added up in blocks."""
    sums = parts.groupBy("window").agg(F.sum("length").alias("tokens")).withColumn("block", F.floor(F.col("window") / BLOCK))
    blocks = sums.groupBy("block").agg(F.sum("tokens").alias("block_tokens"))
    ahead = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", ahead("block_tokens", Window.orderBy("block")).alias("block_at"))
    windows = sums.join(blocks, "block").select("window", (F.col("block_at") + ahead("tokens", Window.partitionBy("block").orderBy("window"))).alias("window_at"))
    inside = ahead("length", Window.partitionBy("window").orderBy(F.col("source").asc_nulls_last(), "place"))
    return parts.withColumn("inside", inside).join(windows, "window").select("part", "seq", "start", "length", (F.col("window_at") + F.col("inside")).alias("at"))


def tail_ends(total: int, length: int) -> np.ndarray:
    """The ends of the sequences that hold what is left at the stream's end: powers of two, the largest first."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return np.array(out, np.int64)


def pack(docs: DataFrame, vocabulary_path: str, length: int = LENGTH, window: int = WINDOW, weights: dict[str | None, int] | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, with ``keep_ids`` the ids too.

    start: the document's ids before the piece; doc_tokens: all its ids, with the end mark; ids_crc32: checksum of the piece's ids as
    little-endian unsigned 32-bit numbers; offset: the sequence's ids before the piece. Sequences have ``length`` ids, but those that hold the
    stream's last ``length - 1`` or fewer have a power of two of them each: nothing has to be padded.

    Each window of ``window`` ids has every source's target proportion, to within one id, until a queue ends; see ``queues``. An empty or null text is
    its end mark alone; rows that repeat are documents of their own; a null doc_id stays null, a null source is one source, the last in
    order; other columns are left out. An empty table gives an empty one. ``window`` must be a positive number.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, vocabulary_path), "packing-tokens")
    # The parts are few numbers a document; written, so that they are worked out once.
    parts = materialize(shares(tokens, window, weights), "packing-shares")
    total = parts.agg(F.sum("length")).first()[0] or 0
    tail, full = tail_ends(total, length), total // length
    placed = stream_places(parts).groupBy(F.col("part").alias("p"), F.col("seq").alias("q")).agg(F.collect_list(F.struct("start", "length", "at")).alias("parts"))
    rows = tokens.join(placed, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))).select("doc_id", "n", "ids", "parts")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n, ids, parts in zip(*(batch.column(k) for k in range(4)), strict=True):
                doc_id, n, ids = doc_id.as_py(), n.as_py(), ids.as_buffer()
                for part in sorted(parts.as_py(), key=lambda p: p["start"]):
                    start, left, at = part["start"], part["length"], part["at"]
                    while left:
                        if at < full * length:
                            number, begin, until = at // length, at - at % length, at - at % length + length
                        else:
                            k = int(np.searchsorted(tail, at, "right"))
                            number, begin, until = full + k, full * length if k == 0 else int(tail[k - 1]), int(tail[k])
                        size = min(left, until - at)
                        own = ids[4 * start : 4 * (start + size)]
                        row = (doc_id, start, size, zlib.crc32(own), n, number, at - begin)
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row)
                        start, left, at = start + size, left - size, at + size
                if len(rows) >= 4096:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)

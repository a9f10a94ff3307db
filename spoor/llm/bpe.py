"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by concatenation.

Every text is split into pieces; a piece starts as a doubly linked list of byte symbols. A heap
holds the possible merges as (rank, position); popping the smallest merges two neighbours and
pushes the pairs that arise. Entries whose symbols have changed meanwhile are stale and skipped.
Pieces repeat, so each task keeps a bounded memo of them; it only saves time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed value: the pre-tokenizer pattern of the byte-level vocabulary (also in public_tokenizers.PATTERN),
#: with the classes for letters, numbers and white space left open.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{L1}{N1}]+|{S1}+(?!{NS})|{S1}+"
#: Pieces that a task remembers.
MEMO = 600_000
#: Longer pieces are not remembered, so a memo's memory is bounded.
LONG = 64


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of each byte: itself if it prints in Latin-1, else the next unused code
    point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_vocabulary(spark: SparkSession, path: str) -> dict:
    """The tokenizer file, read once by the driver. ``path`` may be local or anything Spark reads."""
    if "://" in path:
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    else:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    model = doc["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
    return {"vocab": model["vocab"], "merges": merges, "special": special}


def _ranges(points: list[int]) -> str:
    out, start, last = [], None, None
    for p in [*points, None]:
        if last is not None and (p is None or p != last + 1):
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = p
        elif start is None:
            start = p
        last = p
    return "".join(out)


class Memo(dict):
    """Pieces met so far; emptied when full."""

    def __init__(self, merge_piece):
        self.merge_piece = merge_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge_piece(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary, built in each Python worker on first use."""

    def __init__(self, vocabulary: dict):
        self.vocabulary, self.ready = vocabulary, False

    def __getstate__(self):
        return self.vocabulary

    def __setstate__(self, state):
        self.vocabulary, self.ready = state, False

    def build(self) -> Codec:
        if self.ready:
            return self
        vocab, special = self.vocabulary["vocab"], self.vocabulary["special"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.of_byte = [vocab[alphabet[b]] for b in range(256)]
        ranks, self.made = {}, []  # ranks: of each left symbol, the rank by right symbol
        for rank, (a, b) in enumerate(self.vocabulary["merges"]):
            ranks.setdefault(vocab[a], {}).setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        none = {}.get
        self.rank_of = [ranks[i].get if i in ranks else none for i in range(max(vocab.values()) + 1)]
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Python's own matcher is faster but needs its classes spelt out; it covers the basic plane.
        kinds: dict[str, list[int]] = {"L": [], "N": []}
        for p in range(0x10000):
            kind = unicodedata.category(chr(p))[0]
            if kind in kinds:
                kinds[kind].append(p)
        letters, numbers = _ranges(kinds["L"]), _ranges(kinds["N"])
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.plain = re.compile(PIECE.format(L=f"[{letters}]", N=f"[{numbers}]", S=space, L1=letters, N1=numbers, S1=f"[{space}]", NS=f"[^{space}]")).findall
        self.full = regex.compile(PIECE.format(L=r"\p{L}", N=r"\p{N}", S=r"\p{White_Space}", L1=r"\p{L}", N1=r"\p{N}", S1=r"\p{White_Space}", NS=r"\P{White_Space}")).findall
        self.astral = re.compile("[\U00010000-\U0010ffff]").search
        self.memo = Memo(self.merge_piece)
        self.ready = True
        return self

    def merge_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        of_byte, rank_of, made_of = self.of_byte, self.rank_of, self.made
        symbol = [of_byte[b] for b in piece]
        n = len(symbol)
        # An entry is rank << 32 | position, so the smallest rank comes first and the leftmost of equals.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of[symbol[i]](symbol[i + 1])) is not None]
        if not queue:
            return tuple(symbol)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or symbol[i] < 0 or rank_of[symbol[i]](symbol[j]) != rank:
                continue  # stale: one of the two has been merged meanwhile
            made = symbol[i] = made_of[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of[made](symbol[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of[symbol[h]](made)) is not None:
                push(queue, r << 32 | h)
        return tuple([s for s in symbol if s >= 0])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.special_split is not None and any(s in text for s in self.special):
            out: list[int] = []
            for part in self.special_split.split(text):
                out += [self.special[part]] if part in self.special else self.encode_ordinary(part)
            return out
        return self.encode_ordinary(text)

    def encode_ordinary(self, text: str) -> list[int]:
        pieces = (self.full if not text.isascii() and self.astral(text) else self.plain)(text)
        memo = self.memo
        return list(chain.from_iterable([memo[p] for p in pieces]))

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, the ids and the
    decoded text. One row in, one row out: a null text counts as empty (no ids, digests of the empty
    string); null or repeated doc_ids stay as they are; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary_path))  # one vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # lives as long as the worker, and the codec with its memo in it
        c = own.get("codec") or own.setdefault("codec", Codec({k: own[k] for k in ("vocab", "merges", "special")}).build())
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for t in part.column(1):
                    ids = c.encode(t.as_py() or "")
                    decoded = c.decode(ids)
                    row = (len(ids), sha(",".join([c.decimal[i] for i in ids]).encode()).hexdigest(), sha(decoded.encode()).hexdigest())
                    rows.append((*row, ids, decoded) if keep_ids else row)
                cols = list(zip(*rows, strict=True))
                arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)

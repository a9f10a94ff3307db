import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spoor.llm import packing
from spoor.llm.bpe import Codec, read_vocabulary
from spoor.llm.common import tokenizer_path
from tests.llm.conftest import make

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, library, rows, length=64, window=256, weights=None, docs=None):
    """Every id of every document in one piece, sequences without gaps, whole or of a power of two."""
    out = packing.pack(docs if docs is not None else make(spark, rows), PATH, length, window, weights, keep_ids=True).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        expected[doc_id, tuple([*library.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    # Rows that repeat, or share an id, cannot be told apart by their pieces; together they hold the same ids.
    held, wanted = defaultdict(Counter), defaultdict(Counter)
    for r in out:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        held[r.doc_id].update({(r.doc_tokens, r.start + k, i): 1 for k, i in enumerate(r.ids)})
    for (doc_id, ids), n in expected.items():
        wanted[doc_id].update({(len(ids), k, i): n for k, i in enumerate(ids)})
    for doc_id, want in wanted.items():
        assert sum(held[doc_id].values()) == sum(want.values()) and set(held[doc_id]) == set(want)
    assert set(held) == set(wanted)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(len(ids) * n for (_, ids), n in expected.items())
    assert len(sequences) == total // length + bin(total % length).count("1")
    return out


def corpus(n=120):
    rng = random.Random(5)
    words = "the quick brown fox jumps over a lazy dog don't 123 naïve \n\n x  y".split(" ")
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))), "en", rng.choice(["a", "a", "a", "b", "b", "c", None])) for k in range(n)]


def test_pieces(spark, library, awkward):
    check(spark, library, corpus())
    check(spark, library, awkward, length=1024, window=4096)
    check(spark, library, [(k, "special <|endoftext|> text <|endoftext|>") for k in range(5)])
    assert packing.pack(make(spark, []), PATH).count() == 0


def mixtures(spark, rows, window, weights):
    """Tokens of each window by source."""
    tokens = packing.tokenized(make(spark, rows).repartition(5), PATH)
    tokens = packing.materialize(tokens, "test")
    out = defaultdict(Counter)
    for r in packing.shares(tokens, window, weights).collect():
        out[r.window][r.source] += r.length
    return tokens, out


def plain(totals, window, weights):
    """Deficit round-robin, window by window."""
    left, deficit, out = dict(totals), dict.fromkeys(totals, 0), []
    every = sum(weights[s] for s in totals)
    while any(left.values()):
        taken = {}
        for s in left:
            deficit[s] += window * weights[s]
            taken[s] = min(left[s], deficit[s] // every)
            deficit[s] -= (deficit[s] // every) * every
            left[s] -= taken[s]
        out.append({s: n for s, n in taken.items() if n})
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3, None: 2}])
def test_windows_hold_the_targets(spark, weights):
    rows = corpus()
    tokens, out = mixtures(spark, rows, 100, weights)
    totals = {r.source: r["sum(n)"] for r in tokens.groupBy("source").sum("n").collect()}
    of = totals if weights is None else {s: weights.get(s, 1) for s in totals}
    expected = plain(totals, 100, of)
    assert [dict(out[w]) for w in range(len(expected))] == expected and not set(out) - set(range(len(expected)))
    if weights is None:
        assert all(abs(n - 100 * totals[s] / sum(totals.values())) <= 1 for w in range(len(expected) - 1) for s, n in expected[w].items())
    else:
        check(spark, Tokenizer.from_file(PATH), rows, weights=weights)


def test_hot_source_over_partitions(spark, library):
    """One source with nearly all rows, in many partitions, and many sources of one document."""
    rows = [(k, "hot text of some words " * (k % 7), "en", "hot") for k in range(300)] + [(1000 + k, "rare", "en", f"s{k}") for k in range(60)]
    check(spark, library, rows, window=300, docs=make(spark, rows).repartition(23))


@pytest.mark.parametrize("in_order", [True, False])
def test_chunks_equal_the_library(library, monkeypatch, in_order):
    codec = Codec(read_vocabulary(None, PATH)).build()
    if not in_order:  # as for a vocabulary whose numbers do not tell the order of its merges
        monkeypatch.setattr(codec, "made", codec.made[::-1])
        assert packing.encoder(codec) == codec.encode_ordinary
        monkeypatch.setattr(packing, "encoder", lambda c: c.encode_ordinary)
        monkeypatch.setattr(codec, "made", codec.made[::-1])
    chunks = packing.Chunks(codec)
    texts = ["", " ", "  ", "a  b", " a \n b", "a\n\n  b ", "\t\ta", "x\x1cy z", "don't  we'll", "a 　b", "  a", "é è", "\U0001f600 \U0001f600", "a" * 200 + " b", "a <|endoftext|> b", "tail  ", "\r\n x", "1 2  34"]
    for text in texts:
        assert np.frombuffer(chunks.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text

"""Repetition, mixing, sharding and BPE against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoor.llm import bpe, mixing, repetition, sharding
from spoor.llm.common import tokenizer_path
from tests.llm.conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = tokenizer_path("byte_bpe_50k.json")


def plain_repetition(text, least):
    w = WORD.findall(text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    triple = {k for i in range(n) if longest[i] >= 3 for k in range(i, i + 3)}
    part = {k for i in range(n) if longest[i] >= least for k in range(i, i + longest[i])}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(triple), sum(len(w[k].encode()) for k in part), sum(len(x.encode()) for x in w), max(longest, default=0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#|\x1c\x85", max_size=60), max_size=6), st.integers(1, 6))
def test_measure(texts, least):
    assert repetition.measure(texts, least) == [plain_repetition(t, least) for t in texts]


@pytest.mark.parametrize("period", [1, 7, 5000])
def test_long_text(period):
    """Half a million words that repeat: exact, and in bounded memory."""
    n = 500_000
    tracemalloc.start()
    longest = repetition.longest_repeats(np.arange(n) % period)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = np.arange(n)
    assert (longest == np.where(at >= period, n - at, n - period - at)).all()
    assert peak < 150 * n


def test_rules(spark, awkward):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(50, good), (51, "a b c " * 30), (52, good + " " + " ".join(f"x{i % 40}" for i in range(80))), (53, "few words"), *[r for r in awkward if r[0] != 5]]
    got = {(r.doc_id, r.n_words): r for r in repetition.rules(make(spark, rows)).collect()}
    for i, t, *_ in rows:
        w = plain_repetition(t or "", 8)
        r = got[i, w[0]]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == (*w[1:5], w[7])
        assert r.base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0])
        assert r.kept == (not r.base_failed and w[5] <= 0.4 * w[6] and w[7] <= 120)
    assert got[50, 60].kept and not got[51, 90].kept and not got[52, 140].kept
    assert repetition.rules(make(spark, awkward)).count() == len(awkward)
    assert repetition.rules(make(spark, rows).where("doc_id < 0")).count() == 0


def check_mix(rows, got):
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(2 * size[s] for s in capped)) / free if free else 0
        over = {s for s in order if s not in capped and weight[s] * level >= 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        mine = [r for r in got if r.source == s]
        target = min(2 * size[s], weight[s] * level) if s not in capped else 2 * size[s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 0.5 + len(mine) * (len({(r.doc_id, r.size) for r in mine}) < len(mine))
        assert sum(r.taken % r.size != 0 for r in mine if r.size) <= 1 + len(mine) - len({(r.doc_id, r.size) for r in mine})


def test_mix(spark, sf_dir, awkward):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), "en", rng.choice(["big", "big", "big", "é", "z", None, "tiny"] if i % 50 else ["once"])) for i in range(500)]
    docs = make(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == 500
    check_mix(rows, got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    check_mix(awkward, mixing.mix(make(spark, awkward)).collect())
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0 and mixing.mixed_documents(docs.where("doc_id < 0")).count() == 0


def test_first_words(spark):
    rows = spark.createDataFrame([("  a\tb\n\nc  ", n) for n in (1, 2, 3)], "t string, n int")
    assert [r.x for r in rows.select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()] == ["  a", "  a\tb", "  a\tb\n\nc"]


def plain_shards(rows, limit):
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    sized = [(i, len((t or "").encode()), f"{h(i):060b}") for i, t, *_ in rows]
    out = []
    for i, b, bits in sized:
        for d in range(61):
            same = [x for x in sized if x[2][:d] == bits[:d]]
            if sum(x[1] for x in same) <= limit or len(same) == 1:
                out.append((str(i), b, bits[:d], d, sum(x[1] for x in same), len(same)))
                break
    return sorted(out)


def test_shards(spark, awkward):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(200)] + [(777, "y" * 5000)]
    for limit in (500, 3000, 10**6):
        got = sharding.shards(make(spark, rows), limit).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.shard, r.depth, r.shard_bytes, r.shard_docs) for r in got) == plain_shards(rows, limit)
    repeated = make(spark, [(9, "z" * 100)] * 25 + [(9, "z" * 300), (9, None)] + awkward)
    got = sharding.shards(repeated, 1000).collect()
    assert len(got) == 27 + len(awkward)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rs in by.values():
        assert sum(r.n_bytes for r in rs) == rs[0].shard_bytes and (rs[0].shard_bytes <= 1000 or len(rs) == 1)
    assert sharding.shards(repeated.where("doc_id < 0")).count() == 0


def test_ids_of_one_hash(spark):
    """Documents that collide in all bits share overflow pages and keep their ids."""
    rows = spark.createDataFrame([(1, 600, 5), (2, 600, 5), (2, 600, 5), (None, 600, 5)], "doc_id long, n_bytes long, hash long")
    got = sharding._overflow(rows, 1000).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "None"] and len({r.page for r in got}) == 4


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(None, VOCABULARY)).build()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab's re \n\t1<|endoftext|>é　\x1c\x85", max_size=40)))
def test_bpe_ids(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_special(codec, library):
    for text in ("<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> <|endoftext|>", "x" * 5000, " " * 300):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, awkward, library):
    got = bpe.encode_decode(make(spark, awkward), VOCABULARY, keep_ids=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in awkward:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(t or ""), ids, t or ""))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got) == sorted(want)
    assert bpe.encode_decode(make(spark, awkward).where("doc_id < 0"), VOCABULARY).count() == 0

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from spoor.llm import spelling
from tests.llm.conftest import make


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5, at_least=3, times=2, every=97):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= at_least}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and one_apart(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def ours(spark, rows, **how):
    return sorted(tuple(r) for r in spelling.variants(make(spark, rows), **how).collect())


WORDS = ["letter", "leter", "lettter", "latter", "litter", "later", "ladder", "bladder", "addder", "adder", "naïve", "naive", "Étude", "étude", "aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "abcde", "abcdef", "bcdef"]


def test_variants(spark):
    rows = [(k, " ".join(w.upper() if k % 3 else w for i, w in enumerate(WORDS) for _ in range(1 + (i * 7 + k) % 9)), "en", "s") for k in range(30)]
    found = ours(spark, rows, every=5)
    assert found == brute(rows, every=5)
    assert any(f is not None for _, f, *_ in found)


def test_chains(spark):
    """Forms of forms, words between two of the same frequency, and a word as frequent as its neighbour."""
    times = {"aaaaa": 3, "aaaab": 7, "aaabb": 20, "aabbb": 41, "abbbb": 90, "abbbbb": 90, "acbbbb": 45, "zzzzz": 4, "zzzzy": 4, "zzzyz": 7}
    rows = [(None, f"{w} " * n) for w, n in times.items()]
    found = ours(spark, rows, every=10**9)
    assert found == brute(rows, every=10**9)
    assert {(w, r) for w, _, r, *_ in found} >= {("aaaaa", "abbbb"), ("acbbbb", "abbbb"), ("zzzzz", "zzzzz")}


def test_awkward_rows(spark, awkward):
    assert ours(spark, awkward, least=1, at_least=1) == brute(awkward, least=1, at_least=1)
    assert ours(spark, []) == []
    assert ours(spark, [(1, None), (2, ""), (3, "1 2 3")]) == []


def test_ranges_and_long_words(spark, monkeypatch):
    """Prefixes that go on over several ranges, long words, and texts in several stretches."""
    monkeypatch.setattr(spelling, "RANGE_WORDS", 5)
    monkeypatch.setattr(spelling, "STRETCH", 40)
    monkeypatch.setattr(spelling, "HELD", 3)
    long = "ab" * 2000
    words = [long, long + "c", long[:-1] + "x", "x" + long, long[:1000] + long[1001:]] + ["a" * k for k in range(5, 40)] + ["a" * k + "b" for k in range(5, 40)]
    rows = [(k, " ".join(words)) for k in range(4)]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_numbers_are_nodes(spark, parts):
    words = sorted({w[:k] for w in WORDS for k in range(2, len(w) + 1)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for reverse in (False, True):
        found = spelling.node_numbers(frame, reverse, parts).collect()
        node = {}
        for r in found:
            w = r.word[::-1] if reverse else r.word
            assert len(r.path) == len(w) + 1
            for k, number in enumerate(r.path):
                assert node.setdefault(w[:k], number) == number
        assert len(set(node.values())) == len(node)


@given(st.text("abAé", max_size=12), st.text("abAé", max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_prefix(a, b):
    k = spelling.common_prefix(a, b)
    assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == brute(rows)

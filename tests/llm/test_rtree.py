import math
import random

import numpy as np
import pytest

from spoor.llm import rtree

SCHEMA = "vec_id long, embedding array<float>, label int, tile int, block int, score long, id long, home string"


def make(spark, rows):
    """Vectors with extra columns whose names clash with those the operator uses inside."""
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, "x") for i, v, label in rows], SCHEMA)


def brute(rows, every=100, positives=5, k=5, low=80, high=100):
    own = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        own[i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q] = True
    own = list(own)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in own:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((score(a[2], b[2]), b[0], b[1]) for b in own if b is not a), key=by)
        for p in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and low * p[0] <= 100 * s[0] <= high * p[0]]
            out += [(a[0], p[1], r + 1, n[1], p[0], n[0]) for r, n in enumerate(fits[:k])]
    return sorted(out, key=str)


def ours(spark, rows, **how):
    return sorted((tuple(r) for r in rtree.hard_negatives(make(spark, rows), **how).collect()), key=str)


def vectors(n, d=6, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, d))
    return [(int(k), (centers[rng.integers(5)] + spread * rng.normal(size=d)).astype(np.float32).tolist(), int(rng.integers(4))) for k in rng.permutation(n)]


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_search(spark, monkeypatch, spread):
    monkeypatch.setattr(rtree, "LEAF", 8)
    monkeypatch.setattr(rtree, "FAN", 3)
    monkeypatch.setattr(rtree, "BLOCK", 7)
    rows = vectors(700, spread=spread)
    found = ours(spark, rows, every=20, tile_rows=60)
    assert found == brute(rows, every=20) and found


def test_copies_and_ties(spark, monkeypatch):
    """A third of all rows have one vector, in the labels of the anchors and others; coarse vectors tie."""
    monkeypatch.setattr(rtree, "LEAF", 8)
    rng = random.Random(2)
    rows = [(k, [1.0, 0.5, 0.25] if k % 3 == 0 else [rng.choice([0.5, 1.0, -1.0]) for _ in range(3)], rng.randrange(3)) for k in range(400)]
    assert ours(spark, rows, tile_rows=30) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, d=3)
    rows += [(None, [0.1, 0.2, 0.3], 1), (None, None, None), (100, None, 1), (200, [nan, 0.0, 0.0], 1), (300, [inf, 0.0, 0.0], 1), (400, [None, 1.0, 1.0], 1), (500, [1.0, 1.0, 1.0], None)]
    rows += [(600, [], 1), (600, [0.5], 1), (600, [0.5], 2), (700, [0.5, 0.5, 0.5, 0.5], 3), (700, [0.5, 0.5, 0.5, 0.5], 3), (8, [0.25, 0.5], 2)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == [] and ours(spark, [(0, [1.0], 1)]) == []


def test_large_components(spark):
    """Scores that doubles cannot hold are exact, up to 64 bits."""
    rows = [(k, [2.0**20 + k, -(2.0**19), 1.5 * k], k % 2) for k in range(0, 300, 25)]
    assert ours(spark, rows, every=50) == brute(rows, every=50)
    assert rtree.hard_negatives(make(spark, [(k, [3e38, float(k)], k % 2) for k in range(0, 400, 50)])).count() > 0


def test_bounds_hold(monkeypatch):
    monkeypatch.setattr(rtree, "LEAF", 4)
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(100, 5)))
    tree = rtree.Tree(np.arange(100), np.zeros(100, np.int64), rng.integers(0, 3, 100), v)
    least, most = tree.bounds(v[:10])
    for a in range(10):
        for node, (x, y) in enumerate(tree.leaf):
            scores = tree.vectors[x:y] @ v[a]
            assert least[a][node] <= scores.min() and scores.max() <= most[a][node]
            assert len(set(tree.labels[x:y])) == 1
    assert sorted(i for x, y in tree.leaf for i in tree.ids[x:y]) == list(range(100))


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted((tuple(r) for r in rtree.hard_negatives(table).collect()), key=str) == brute(rows)

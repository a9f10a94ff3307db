"""Shards are dealt as by one greedy pass, without one."""

import random

from spoor.operators import corpus


def brute(sizes, shards):
    load, out = [0] * shards, {}
    for package, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        out[package] = load.index(min(load))
        load[out[package]] += n
    return out


def test_rounds_are_greedy():
    rng = random.Random(1)
    for _ in range(500):
        shards = rng.randint(1, 9)
        counts = {w: rng.randint(0, 30) for w in rng.sample(range(1, 40), rng.randint(1, 5))}
        load, want, got = [0] * shards, [], []
        plain = [0] * shards
        for w in sorted(counts, reverse=True):
            first, turn = corpus.deal(counts[w], w, load)
            got += [first[k] if k < len(first) else turn[(k - len(first)) % shards] for k in range(counts[w])]
            for _ in range(counts[w]):
                want.append(plain.index(min(plain)))
                plain[want[-1]] += w
        assert got == want and load == plain


def test_plan_is_greedy_and_has_no_single_task(spark):
    rng = random.Random(2)
    sizes = {f"p{rng.random()}": rng.choice([1, 2, 2, 3, 5, 5, 5, 11]) for _ in range(3000)}
    plan = spark.createDataFrame([(p, str(v)) for p, n in sizes.items() for v in range(n)], "package string, version string")
    for shards in (1, 7):
        got = corpus.shard_plan(plan, shards)
        assert {r.package: r.shard for r in got.collect()} == brute(sizes, shards)
        assert [r.versions == sizes[r.package] for r in got.collect()].count(False) == 0
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()

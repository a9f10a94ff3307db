import random
from itertools import combinations

from spoor.llm import jaccard
from spoor.llm.components import components
from tests.llm.conftest import make


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted((str(rows[k][0]), len(sets[k]), str(least[root(k)])) for k in range(len(rows)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] + passage
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 1, 2, 4]))))
    big = [rng.choice(vocabulary) for _ in range(120)]
    rows += [" ".join(edited(rng, big, rng.randint(0, 5))) for _ in range(300)]
    chain = [f"c{i}" for i in range(400)]
    rows += [" ".join(chain[k : k + 100]) for k in range(0, 60, 3)]
    rows += ["", "one", "ONE", "one two", "One Two", "one two three", "one two three", "one two three four"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    for n, percent in ((3, 90), (5, 80), (2, 60)):
        assert got(jaccard.join(make(spark, rows), n, percent)) == brute(rows, n, percent)


def test_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 16)
    rows = corpus()
    assert got(jaccard.join(make(spark, rows), 3, 90)) == brute(rows, 3, 90)


def test_groups_across_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "SIDE", 16)
    rows = corpus()
    for n, percent in ((3, 90), (2, 60)):
        assert got(jaccard.join(make(spark, rows), n, percent)) == brute(rows, n, percent)


def test_sets_with_one_hash(spark):
    """Two sets that share their first hash stay two."""
    profile = spark.createDataFrame([(1, 1, 5, 77, 8), (2, 2, 5, 77, 9), (3, 3, 5, 77, 9), (4, 4, 0, None, None)], "doc_id long, tie long, size long, node long, twin long")
    sets = jaccard.different_sets(profile).collect()
    assert sorted((s.twin, s.doc_id) for s in sets) == [(8, 1), (9, 2)]
    assert len({s.id for s in sets}) == 2 and 77 in {s.id for s in sets}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(jaccard.join(docs, 3, 90)) == brute(rows, 3, 90)
    found = brute(rows, 5, 80)
    kept = {str(r.doc_id) for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i, _, c in found if i == c}


def test_awkward(spark, awkward):
    docs = make(spark, awkward)
    assert got(jaccard.join(docs, 3, 90)) == brute(awkward, 3, 90)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    # one of the two alike rows, the other text of id 1, one of 7 and 8, the row without id, what has no words
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "None", "None", "5", "6", "7"])
    assert jaccard.join(docs.where("doc_id < 0")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root(x) for x in parent if x not in alone}


def test_a_family_is_sent_in_proportion(spark, monkeypatch):
    """Twice as many near copies of one text send twice as many sets, however small the blocks."""
    monkeypatch.setattr(jaccard, "SIDE", 8)
    place, sent = jaccard._placed_sets, []

    def counted(*args):
        out = place(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_placed_sets", counted)
    rng, totals = random.Random(1), []
    base = [f"w{k}" for k in range(220)]
    for m in (40, 80):
        sent.clear()
        rows = [(k, " ".join(edited(rng, base, 1))) for k in range(m)]
        assert {r.component_id for r in jaccard.join(make(spark, rows), 3, 90).collect()} == {0}
        totals.append(sum(sent))
    assert 0 < totals[1] <= 2.3 * totals[0] and totals[1] <= 3 * 80

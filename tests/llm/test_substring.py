import hashlib
import random
from collections import Counter

from spoor.llm import substring
from tests.llm.conftest import make


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_random_passages(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é", "the", "a"]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 50))]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            parts += p
        rows.append((i, " ".join(parts)))
    rows += [(500 + k, "x y " * 40) for k in range(3)] + [(600, "z " * 36), (601, "z " * 35), (602, "z " * 34)]
    assert got(substring.remove_repeats(make(spark, rows))) == brute(rows, 35)
    assert got(substring.remove_repeats(make(spark, rows), batches=2, window=9, anchor=4)) == brute(rows, 9)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(substring.remove_repeats(docs)) == brute(rows, 35)


def test_awkward(spark, awkward):
    assert got(substring.remove_repeats(make(spark, awkward))) == brute(awkward, 35)
    assert substring.remove_repeats(make(spark, awkward).where("doc_id < 0")).count() == 0
    kept = substring.remove_repeats(make(spark, awkward), keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in kept)


def test_runs_meet_and_merge(spark):
    index = substring.FingerprintIndex(spark, buckets=4)
    place = "doc_id long, tie long, start int, size int"
    rows = lambda *r: spark.createDataFrame([(*x, k, 0, 1, 1) for k, x in enumerate(r)], f"anchor long, content long, {place}")
    met = lambda *r: {(x.anchor, x.content, x.new, x.old, x.contents) for x in index.meet(index.run_of(rows(*r))).collect()}
    index.add(index.run_of(rows((1, 1), (1, 2), (2, 5))))
    assert met((1, 2), (9, 9), (7, 7), (7, 7), (2, 6)) == {(1, 1, 0, 1, 2), (1, 2, 1, 1, 2), (7, 7, 2, 0, 1), (2, 5, 0, 1, 2), (2, 6, 1, 0, 2)}
    index.add(index.run_of(rows((1, 2), (3, 3))))
    index.add(index.run_of(rows((1, 2))))
    assert len(index.levels) == 2
    assert {tuple(r)[:3] for r in index.compact().collect()} == {(1, 1, 1), (1, 2, 3), (2, 5, 1), (3, 3, 1)}


def test_a_bucket_is_one_file(spark):
    """Runs, new and merged, have a file for each bucket, however many tasks counted them."""
    index = substring.FingerprintIndex(spark, buckets=5)
    files = lambda name: spark.table(name).inputFiles()
    for k in range(2):
        rows = spark.range(3000).selectExpr(f"(id + {k}) % 700 AS anchor", f"id + {k} AS content", "id AS doc_id", "id AS tie", "0 AS start", "1 AS size")
        run = index.run_of(rows.repartition(7))
        assert len(files(run)) == 5
        index.add(run)
    assert [len(files(name)) for _, name in index.levels] == [5]
    assert spark.table(index.levels[0][1]).count() == 3001
    index.drop()


def test_batches_of_two_sessions(spark):
    """Each batch is decided when it enters, the second one in a session that opens the index anew: a passage that an older document quotes
    inside other text, one that only meets its like in the second batch, and one that the first batch held twice."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    quoted, common, twice = text(35), text(60), text(50)
    first = [(0, text(90) + quoted + text(80)), (1, text(20) + common), (2, twice + text(40)), (3, text(10) + twice), (None, text(70) + common[:40])]
    second = [(10, text(33) + quoted + text(47)), (11, common + text(5)), (12, text(200)), (13, twice[3:48])]
    old, new = ([(i, " ".join(w)) for i, w in rows] for rows in (first, second))

    def spans(frame):
        return [(r.doc_id, r.tie, r.start, r.size) for r in frame.collect()]

    index = substring.FingerprintIndex(spark, buckets=4)
    docs = substring.keyed(make(spark, old))
    found = spans(substring.repeats_with(index, substring.segments(docs), docs))
    saved = index.saved()
    for _, name in index.levels:
        spark.sql(f"DROP TABLE {name}")
    session = spark.newSession()
    again = substring.FingerprintIndex.reopen(session, saved)
    every, batch = substring.keyed(make(session, old + new)), substring.keyed(make(session, new))
    found += spans(substring.repeats_with(again, substring.segments(batch), every))
    again.drop()

    covered = Counter()
    for doc_id, _, start, size in set(found):
        for k in range(start, start + size + 34):
            covered[doc_id, k] = 1
    removed = Counter(i for i, _ in covered)
    assert {i: n for i, _, n, _ in brute(old + new, 35) if n} == {str(i): n for i, n in removed.items()}
    assert removed[0] == removed[10] == 35

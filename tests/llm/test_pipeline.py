import hashlib
from collections import Counter

import corpus_pipeline
from spoor.llm import language
from tests.llm.conftest import make
from tests.llm.test_jaccard import brute as components_of
from tests.llm.test_secrets import brute as secrets_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        rows = docs.collect()
        seen.append(name)
        if name == "language":
            pred = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            assert {r.doc_id for r in rows} == {i for i, p in pred.items() if p.lang_pred != "und" and not p.ambiguous}
        if name == "near_duplicates":
            found = components_of([(i, r.text) for i, r in before.items()], 5, 80)
            assert {str(r.doc_id) for r in rows} == {i for i, _, c in found if i == c}
        if name == "secrets":
            assert {r.doc_id for r in rows} == set(before)
            assert all((r.text != before[r.doc_id].text) == bool(secrets_of(before[r.doc_id].text)[4]) for r in rows)
        if name == "mix":
            assert {r.doc_id for r in rows} <= set(before)
            assert all(before[r.doc_id].text.startswith(r.text) for r in rows)
            mixed_to_targets(before.values(), rows)
        if name == "encode":
            assert sorted((r.doc_id, r.decoded_sha256) for r in rows) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in mixed)
        mixed = [(r.doc_id, r.text) for r in rows] if k < len(corpus_pipeline.STAGES) - 1 else []
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(rows, docs.schema)
    assert seen == ["language", "near_duplicates", "secrets", "mix", "encode"]


def size(text):
    return len((text or "").encode().split())


def mixed_to_targets(before, after):
    """Each source has its budget to the word, and each document whole epochs, one more, or a part of it once."""
    sizes, weights = Counter(), {}
    for r in before:
        sizes[r.source] += size(r.text)
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        weights[s] = (3, 1, 2)[k % 3]
    target, open_ = {}, set(sizes)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else weights[s] * level
        open_ = open_ - over if over else set()
    taken, times = Counter(), Counter()
    for r in after:
        taken[r.source] += size(r.text)
        times[r.doc_id] += 1
    assert all(taken[s] == round(target[s]) for s in sizes)
    assert max(times.values()) <= 2 and len(set(times.values())) == 2


def run_over(spark, tmp_path, rows):
    docs = make(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_awkward_rows(spark, sf_dir, tmp_path, awkward):
    """Nulls, empty texts, rows that repeat and columns with clashing names go through all stages; what is left are known texts."""
    rows = [(10_000 + r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [*rows[:3], *awkward]
    out = run_over(spark, tmp_path, rows)
    assert out and {r.doc_id for r in out} <= {i for i, *_ in rows} and all(r.n_tokens > 0 for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_no_rows(spark, tmp_path):
    assert run_over(spark, tmp_path, []) == []

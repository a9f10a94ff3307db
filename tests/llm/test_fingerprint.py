import hashlib
import re

from pyspark.sql import functions as F

from spoor.llm import fingerprint as fp
from tests.llm.conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        j = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), j(shingles(t), shingles(edited)), j(shingles(t), shingles(nxt)), len(shingles(t)))
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = fp.compare_edits(docs, k=100_000).collect()
    assert len(got) == len(want)
    for r in got:  # with sketches that hold everything the estimates are exact
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert abs(r.near_edited - want[r.doc_id][2]) < 1e-12 and abs(r.near_next - want[r.doc_id][3]) < 1e-12
        assert r.n_shingles == want[r.doc_id][4]
    near = fp.compare_edits(docs).collect()
    errors = [abs(r.near_edited - want[r.doc_id][2]) for r in near]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    by_text = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in near:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_awkward(spark, awkward):
    got = fp.compare_edits(make(spark, awkward)).collect()
    assert len(got) == len(awkward)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    docs = make(spark, [(1, "x")])
    assert fp.compare_edits(docs.where("doc_id < 0")).count() == 0
    one = fp.compare_edits(make(spark, [(1, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_rows_of_one_id(spark):
    """Hundreds of texts of one id, and of none, follow each other across ranges."""
    rows = [(i, f"text {k} " * 3 + "of one id") for i in (None, 7) for k in range(200)] + [(k, f"document {k}") for k in range(20)]
    docs = make(spark, rows)
    ranged = fp.in_ranges(docs, 32).where("not ghost").groupBy("range").count().collect()
    assert len(ranged) > 16 and max(r["count"] for r in ranged) < len(rows) / 8
    tied = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("h")).collect()
    order = sorted(tied, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = []
    for k, r in enumerate(order):
        q = len(r.text) // 4
        want.append((str(r.doc_id), hashlib.sha256((r.text[: len(r.text) - q] + order[(k + 1) % len(order)].text[:q]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fp.compare_edits(docs).collect()) == sorted(want)


def test_merge(spark):
    text = [f"w{i}" for i in range(3000)]
    parts = [" ".join(text[i : i + 304]) for i in range(0, 3000, 300)]
    rows = spark.createDataFrame([(1, " ".join(text))] + [(2, p) for p in parts], "g int, t string")
    sketched = fp.sketches(rows, {"s": F.col("t")})
    whole, merged = (sorted(r.s) for r in fp.merge_parts(sketched, ["g"], "s").orderBy("g").collect())
    assert whole == merged
    pair = fp.sketches(spark.createDataFrame([(" ".join(text), " ".join(text[:1500]))], "a string, b string"), {"x": F.col("a"), "y": F.col("b")})
    r = pair.select(fp.containment(F.col("y"), F.col("x")).alias("c"), fp.distinct_shingles(F.col("x")).alias("n")).first()
    assert r.c > 0.75 and abs(r.n - 2996) < 900

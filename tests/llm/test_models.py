import math
import random
import string
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pytest

from spoor.llm import language, quality
from tests.llm.conftest import make

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["ther", "ing", "out"], "cc": ["çon", "eau", "ré"]}


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words), lang, "s"))
    return rows


def test_codewords():
    for k in (2, 3, 4, 7, 9, 20):
        code = language.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
        assert all(len(set(c)) == 2 for c in code.T.tolist())
    assert language.codewords(1).shape == (1, 0)
    least = min((language.codewords(20)[a] != language.codewords(20)[b]).sum() for a in range(20) for b in range(a))
    assert least >= 15


def plain_languages(rows):
    """Counts, codewords, log odds and loss-weighted decoding, one gram and one bit at a time."""
    grams = lambda t: [tuple(f" {t.lower()} ".encode()[i : i + 3]) for i in range(len(f" {t.lower()} ".encode()) - 2)]
    hashed = lambda g: ((g[0] * 0x9E3779B1 & M ^ g[1] * 0x85EBCA6B & M ^ g[2] * 0xC2B2AE35 & M) * 0x27D4EB2F & M) >> 19
    M, size = 0xFFFFFFFF, 8192
    count = {}
    for i, text, lang, _ in rows:
        if crc32(str(i).encode()) % 3 != 1:
            for g in grams(text):
                count.setdefault(lang, {}).setdefault(hashed(g), 0)
                count[lang][hashed(g)] += 1
    langs = sorted(count)
    total = {x: sum(count[x].values()) + size / 2 for x in langs}
    share = lambda x, f: (count[x].get(f, 0) + 0.5) / total[x]
    splits = [[1 if i == 0 or not m >> i - 1 & 1 else -1 for i in range(len(langs))] for m in range(1, 1 << len(langs) - 1)]
    side = lambda split, s, f: sum(share(x, f) for x, b in zip(langs, split, strict=True) if b == s) / split.count(s)
    odds = [[math.log(side(split, 1, f)) - math.log(side(split, -1, f)) for f in range(size)] for split in splits]
    apart = [sum((side(split, 1, f) - side(split, -1, f)) * w[f] for f in range(size)) for split, w in zip(splits, odds, strict=True)]
    weight = [a * len(apart) / sum(apart) for a in apart]
    out = {}
    for i, text, _, _ in rows:
        found = [hashed(g) for g in grams(text)]
        margin = [sum(w[f] for f in found) / math.sqrt(len(found)) for w in odds]
        loss = [sum(wt * math.log1p(math.exp(-m * split[k])) for wt, m, split in zip(weight, margin, splits, strict=True)) for k in range(len(langs))]
        like = [math.exp(min(loss) - x) for x in loss]
        out[i] = (langs[loss.index(min(loss))], max(like) / sum(like))
    return out


def test_languages_against_plain_version(spark):
    rows = corpus(90, seed=9)
    want = plain_languages(rows)
    got = language.identify(make(spark, rows)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: w[0] for i, w in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-9 for r in got)


def test_long_text_in_chunks(monkeypatch):
    model = language.LanguageModel(["a", "b"], language.codewords(2), np.random.default_rng(1).normal(size=(language.N_FEATURES, 1)), np.ones(1))
    text = "".join(random.Random(3).choice("abcdé ") for _ in range(3 * language.N_FEATURES))
    whole = model.margins(text)
    monkeypatch.setattr(language, "CHUNK", 1000)
    assert np.allclose(model.margins(text), whole)


def test_ftrl_against_formulas():
    """Per coordinate: w = 0 if |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2); g = (p - y) x;
    z += g - (sqrt(n + g^2) - sqrt n) / alpha w; n += g^2."""
    rng = random.Random(5)
    model, z, n = quality.Ftrl(), {}, {}
    for _ in range(300):
        index = sorted(rng.sample(range(50), rng.randint(1, 8)))
        value, label = [rng.uniform(0.1, 1) for _ in index], rng.randint(0, 1)
        w = {}
        for i in index:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= model.l1 else -(zi - math.copysign(model.l1, zi)) / ((model.beta + math.sqrt(ni)) / model.alpha + model.l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(index, value, strict=True))))
        for i, v in zip(index, value, strict=True):
            g, ni = (p - label) * v, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / model.alpha * w[i]
            n[i] = ni + g * g
        model.update(np.array(index), np.array(value), label)
    assert all(abs(model.z[i] - z.get(i, 0)) < 1e-9 and abs(model.n[i] - n.get(i, 0)) < 1e-9 for i in range(50))


def test_languages_held_out(spark):
    rows = corpus()
    want = {i: lang for i, _, lang, _ in rows}
    got = language.identify(make(spark, rows)).collect()
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_lang_of_held_out_is_no_input(spark):
    rows = corpus()
    lied = [(i, t, "aa" if crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())
    assert key(language.identify(make(spark, rows))) == key(language.identify(make(spark, lied)))


def test_language_awkward(spark, awkward):
    docs = make(spark, corpus() + [(1000 + (i or 0), *r) for i, *r in awkward] + [(None, "12 34 !", "aa", "s")])
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[1002].lang_pred == got[1003].lang_pred == got[None].lang_pred == "und" and got[1003].score == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= set(got) - {1002, 1003, 1004, None}
    nothing = make(spark, [(i, t, None, "s") for i, t, _, _ in corpus(5)])
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}
    assert language.identify(docs.where("doc_id < 0")).count() == 0


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.identify(docs).collect() if r.held_out]
    assert sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def labelled(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("kalomitu") * rng.randint(1, 3) + rng.choice(["ka", "lo"]) for _ in range(rng.randint(10, 60))]
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    return docs, labels


def test_quality_held_out(spark):
    rows, labels = labelled()
    docs, marks = make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    want = dict(labels)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(want[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)
    lied = spark.createDataFrame([(i, 1 - q if crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels], "doc_id long, quality int")
    assert sorted((r.doc_id, r.score) for r in quality.classify(docs, lied).collect()) == sorted((r.doc_id, r.score) for r in got)


def test_quality_awkward(spark, awkward):
    docs = make(spark, awkward)
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (5, 0), (999, 1)], "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(awkward)
    empty = [r.score for r in got if r.doc_id in (2, 3, 4)]
    assert len(set(empty)) == 1
    none = quality.classify(docs, marks.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.where("doc_id < 0"), marks).count() == 0


def test_ftrl_separates():
    model = quality.Ftrl()
    words = quality.Words()
    for _ in range(30):
        model.update(*quality.features("good clean text", words), 1)
        model.update(*quality.features("bad ### noise", words), 0)
    w = model.weights(slice(None))
    dot = lambda t: float(w[(f := quality.features(t, words))[0]] @ f[1])
    assert dot("good clean text") > 1 > -1 > dot("bad ### noise")
    assert np.count_nonzero(w) < 30
    assert quality.sigmoid(1000) == pytest.approx(1.0)


def plain_features(text):
    """Numbers and values of a text's features, one by one."""
    for c in string.punctuation:
        text = text.replace(c, f" {c} ")
    words = text.split()
    h = [crc32(w.lower().encode()) & quality.MASK for w in words]
    n = Counter(h)
    for a, b in pairwise(h):
        n[(a * 0x2545F491 + b * 0x9E3779B1 >> 7) & quality.MASK] += 1
        n[quality.REPEATED] += a == b
    n[quality.CAPITALS] += sum(len(w) > 1 and w.isupper() for w in words)
    n = {i: k for i, k in n.items() if k and i != quality.BIAS}
    unit = max(math.sqrt(sum(n.values())), 1)
    return {i: math.sqrt(k) / unit for i, k in sorted(n.items())} | {quality.BIAS: 0.3}


def test_classify_against_a_plain_version(spark, sf_dir):
    """Features, rows learnt from, their order, updates, epochs and scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label = {}
    for r in labels.collect():
        if r.quality is not None and crc32(str(r.doc_id).encode()) % 4 != 2:
            label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    made = {i: plain_features(t or "") for i, t in rows}
    learnt = sorted((i for i, t in rows if i in label and t is not None), key=lambda i: (crc32(str(i).encode()), i))
    assert learnt and len(learnt) <= quality.MAX_ROWS
    at, z, n = quality.Ftrl(), Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= at.l1 else -(z[i] - math.copysign(at.l1, z[i])) / ((at.beta + math.sqrt(n[i])) / at.alpha + at.l2)

    def dot(x):
        return 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))

    for _ in range(2):
        for k in learnt:
            x = {i: float(np.float32(v)) for i, v in made[k].items()}
            w, p = {i: weight(i) for i in x}, dot(x)
            for i, v in x.items():
                g = (p - label[k]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / at.alpha * w[i]
                n[i] += g * g
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        want = dot(made[i])
        assert abs(got[i].score - want) < 1e-4 and got[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(got[i].score >= 0.7)

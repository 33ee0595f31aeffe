"""Language ID, toxicity and quality rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchloom.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_trigrams():
    ids, n = langid.trigram_counts("Ab, ab!")
    place = lambda s: sum((0 if c == " " else ord(c)) * langid.PLACES ** (2 - i) for i, c in enumerate(s))
    assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {place(" ab"): 2, place("ab "): 2, place("b a"): 1}
    assert [len(langid.trigram_counts(t)[0]) for t in ("", "12 !", "a")] == [0, 0, 1]


def test_binding_and_bundling():
    ids, n = langid.trigram_counts("hello world")
    table = langid.Vectors(64, 3, most=5)
    letters = langid.letter_vectors(64, 3).astype(int)
    text = " hello world "
    place = lambda c: 0 if c == " " else ord(c)
    expected = sum(np.roll(letters[place(a)], 2) * np.roll(letters[place(b)], 1) * letters[place(c)] for a, b, c in zip(text, text[1:], text[2:], strict=False))
    for _ in range(2):
        assert (table.bundle([(ids, n), langid.trigram_counts("abc")])[0] == expected).all()


def test_blocks_of_trigrams_change_nothing(monkeypatch):
    texts = ["hello world, this is a text", "ein anderer Text über Vieles", "日本語の文章です、とても長い"]
    counted = [langid.trigram_counts(t) for t in texts]
    whole = langid.Vectors(64, 3).bundle(counted)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.Vectors(64, 3, most=9).bundle(counted) == whole).all()


def brute_identify(texts, training, dimensions=256, seed=7):
    """Prototypes and cosines text by text, a vector for each trigram occurrence."""
    letters = langid.letter_vectors(dimensions, seed).astype(float)
    places = langid.letter_places()

    def vector(text):
        runs = re.sub(r"[^\W\d_]+", lambda m: m.group(), "".join(c if c.isalpha() else " " for c in text)).split()
        line = [0, *(x for r in runs for x in [*(int(places[ord(c)]) for c in r), 0])]
        out = np.zeros(dimensions)
        for a, b, c in zip(line, line[1:], line[2:]):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out if runs else None

    sums = {}
    for lang, text in training:
        if lang is not None and text:
            v = vector(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v
    langs, found = sorted(sums), []
    for t in texts:
        v = vector(t or "")
        if v is None or not langs:
            found.append(("und", 0.0))
            continue
        cosines = [float(v @ sums[k] / max(np.linalg.norm(v) * np.linalg.norm(sums[k]), 1e-30)) for k in langs]
        best = int(np.argmax(np.round(cosines, 5)))
        found.append((langs[best], min(1, max(0, cosines[best]))))
    return found


def test_identify_against_brute_force(spark):
    rows = [(1, "The cat and the dog", "en"), (2, "Der Hund und die Katze", "de"), (3, "and the", None), (4, "und der", None), (5, "12 !", "en"), (6, None, "fr"), (7, "x", None), (8, "Straße, Été", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (3, 1_000_000):
        profiles = langid.count_profiles(docs, most=part)
        langs, vectors = langid.prototypes(profiles, 256, 7)
        assert langs == ["de", "en"] and vectors.shape == (2, 256)
    got = langid.identify(docs, docs, dimensions=256).collect()
    for r, (lang, score) in zip(got, brute_identify([x[1] for x in rows], [(x[2], x[1]) for x in rows]), strict=True):
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=2e-5)


def test_language_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog", "en", 1.0, "a", 3)], "doc_id long, text string, lang string, Score double, LANG_PRED string, `a b` int")
    got = langid.identify(docs, docs)
    assert got.columns == ["doc_id", "text", "lang", "a b", "lang_pred", "score", "n_trigrams"] and got.first().lang_pred == "en"
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 1
    twice = docs.toDF("doc_id", "text", "lang", "x", "x", "lang_pred")
    assert langid.stage(spark, twice, "").columns == twice.columns and langid.stage(spark, twice, "").count() == 1


def test_language_stage_by_the_noise_level(spark):
    """Text of an unlearned alphabet goes, a few clean words stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(0)
    cyrillic = [(10**6 + i, "".join(rng.choice(list("абвгдежзийклмнопрст "), int(n))), None) for i, n in enumerate([40, 200, 1000] * 20)]
    kept = langid.stage(spark, docs.union(spark.createDataFrame(cyrillic, docs.schema)), "").collect()
    assert sum(r.doc_id >= 10**6 for r in kept) <= 2
    own = {r.doc_id for r in kept}
    letters = [r for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    assert sum(r.doc_id in own for r in letters) / len(letters) >= 0.998


def test_held_out_language(spark):
    found = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    got = langid.identify(odd_documents, odd_documents).collect()
    assert len(got) == 12 and {r.lang_pred for r in got if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    assert langid.identify(no_documents, odd_documents).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_documents, no_documents).collect()} == {"und"}
    kept = langid.stage(spark, odd_documents, "")
    assert kept.columns == odd_documents.columns and 2 not in [r.doc_id for r in kept.collect()]
    assert {r.score for r in kept.collect()} == {0.5}


def test_non_negative_risk_finds_the_words():
    rng = np.random.default_rng(0)
    doc = lambda bad: np.array(sorted({*rng.integers(100, 5000, 30).tolist(), *([int(rng.integers(0, 5))] if bad else [])}))
    positive, unlabelled = [doc(True) for _ in range(300)], [doc(rng.random() < 0.2) for _ in range(3000)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    w = model.table()
    assert set(range(5)) <= set(w) and all(model.bias + w[k] > 1 for k in range(5)) and model.bias < -1
    assert toxicity.fit([], unlabelled, 0.1).bias == pytest.approx(np.log(1 / 9))


def brute_risk(positive, unlabelled, hashes, w, b, prior):
    """The two parts of the risk, document by document."""
    weight = dict(zip(hashes.tolist(), w))
    z = lambda doc: b + sum(weight.get(h, 0.0) for h in doc.tolist())
    loss = lambda x: np.log(1 + np.exp(x))
    r_pp = np.mean([loss(-z(d)) for d in positive])
    r_pn = np.mean([loss(z(d)) for d in positive])
    r_un = np.mean([loss(z(d)) for d in unlabelled])
    return prior * r_pp, r_un - prior * r_pn


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(2)
    docs = lambda n: [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(n)]
    positive, unlabelled, hashes = docs(15), docs(40), np.arange(2, 9)
    w, b, prior = rng.normal(size=7), 0.3, 0.2
    p, u = toxicity.Side(positive, hashes), toxicity.Side(unlabelled, hashes)
    a, c, ga, gc = toxicity.risk_parts(p, u, w, b, prior)
    assert (a, c) == pytest.approx(brute_risk(positive, unlabelled, hashes, w, b, prior))
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        up = brute_risk(positive, unlabelled, hashes, w + step[:7], b + step[7], prior)
        down = brute_risk(positive, unlabelled, hashes, w - step[:7], b - step[7], prior)
        assert ((up[0] - down[0]) / 2e-6, (up[1] - down[1]) / 2e-6) == pytest.approx((ga[i], gc[i]), abs=1e-6)


def test_a_negative_risk_is_driven_back():
    """The part that would fall below zero is held near it; a plain minimum would go on falling."""
    rng = np.random.default_rng(5)
    doc = lambda bad: np.unique(np.r_[rng.integers(10, 30, 4), [1] if bad else []].astype(np.int64))
    positive, unlabelled = [doc(True) for _ in range(60)], [doc(rng.random() < 0.1) for _ in range(200)]
    model = toxicity.fit(positive, unlabelled, 0.3, hashes=np.arange(0, 30), least_docs=1)  # the prior is too high
    parts = brute_risk(positive, unlabelled, model.hashes, model.weights, model.bias, 0.3)
    assert -0.02 < parts[1] < 0.1


def test_scores_against_brute_force(spark, odd_documents):
    names = ["alpha", "beta", "^gam", "^alph", "zeta"]
    hashes = np.array(sorted({toxicity.key(n, j) for n in names for j in (1, 2, 3)}), np.int64)
    model = toxicity.Model(hashes, np.linspace(-1, 1, len(hashes)), -0.5)
    table = model.table()
    for r in toxicity.score(odd_documents, model).collect():
        z = -0.5 + sum(table.get(h, 0.0) for h in toxicity.features(r.text))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-9)


def test_sample_counts_and_encoding(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("toxic = 1").select("doc_id")
    texts = toxicity.sample(corpus, labels, corpus.limit(30), "doc_id", "text")
    rows = {r.doc_id: r.text for r in corpus.collect()}
    ids = [r.doc_id for r in labels.collect() if r.doc_id in rows]
    expected = Counter(h for d in ids for h in toxicity.features(rows[d]))
    assert {r.f: r.n for r in toxicity.count_features(texts.where("p"), None).collect()} == dict(expected)
    kept = np.array(sorted(h for h, n in expected.items() if n > 1), np.int64)
    assert {r.f: r.n for r in toxicity.count_features(texts.where("p"), kept).collect()} == {h: expected[h] for h in kept.tolist()}
    positive, unlabelled = toxicity.encoded(texts, kept)
    assert len(positive) == len(ids) and len(unlabelled) == 30
    assert sorted(map(tuple, positive)) == sorted(tuple(sorted(toxicity.features(rows[d]) & set(kept.tolist()))) for d in ids)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in found)
    caught = [r for r in held if r.toxic and r.predicted]
    assert len(caught) / sum(r.toxic for r in held) > 0.9
    assert len([r for r in held if not r.toxic and r.predicted]) <= 0.01 * len(held)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(odd_documents, labels)
    scored = toxicity.score(odd_documents, model)  # which has a score of its own
    rows = scored.select("doc_id", "score").collect()
    assert scored.columns.count("score") == 1 and len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd_documents.withColumnRenamed("score", "SCORE"), model).select("score").count() == 12
    assert toxicity.score(no_documents, model).count() == 0
    none = toxicity.train(no_documents, labels.limit(0))
    assert all(0 <= r.score < 0.01 for r in toxicity.score(odd_documents, none).collect())


def test_toxicity_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(9.0))
    kept = toxicity.stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def brute_repeats(words, window=5):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(window)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeat_words(words):
    assert quality.repeat_words(words) == brute_repeats(words)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAZ #*$%&|<>\n\t\x0b\x0c\r\x1c é", max_size=80))
def test_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    s = quality.statistics(text)
    assert quality.uppers(text + "ÄßÉ日Σ") == sum(map(str.isupper, text + "ÄßÉ日Σ"))
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup)


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(3)
    good, alarm, find = 0.8, np.array([0.01, 0.02, 0.05, 0.3]), np.array([0.6, 0.5, 0.7, 0.3])
    patterns = Counter()
    for _ in range(30_000):
        bad = rng.random() > good
        patterns["".join("b" if rng.random() < p else "g" for p in (find if bad else alarm))] += 1
    share, on_good, on_bad = quality.estimate(patterns, belief=0.001)
    assert share == pytest.approx(good, abs=0.05)
    assert on_good == pytest.approx(alarm, abs=0.05) and on_bad == pytest.approx(find, abs=0.1)


def brute_posterior(pattern, share, on_good, on_bad):
    """Bayes' rule, rule by rule."""
    good, bad = share, 1 - share
    for c, a, b in zip(pattern, on_good, on_bad):
        if c == "b":
            good, bad = good * a, bad * b
        elif c == "g":
            good, bad = good * (1 - a), bad * (1 - b)
    return good / (good + bad)


def test_verdicts_against_brute_force(spark):
    """The posterior of every pattern by Bayes' rule, and one step of expectation-maximisation changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.judge(docs).collect()
    patterns = Counter(r.votes for r in rows)
    share, on_good, on_bad = quality.estimate(patterns)
    for r in rows:
        p = brute_posterior(r.votes, share, on_good, on_bad)
        assert r.quality_probability == pytest.approx(p, abs=1e-8)
        assert r.kept == (not r.base_failed and r.quality_probability >= 0.5)
    weight = 0.1 * len(rows) + 1
    q = {v: brute_posterior(v, share, on_good, on_bad) for v in patterns}
    assert (sum(n * q[v] for v, n in patterns.items()) + 0.85 * weight) / (len(rows) + weight) == pytest.approx(share, abs=1e-6)
    for i in range(quality.RULES):
        bad = sum(n * q[v] for v, n in patterns.items() if v[i] == "b")
        cast = sum(n * q[v] for v, n in patterns.items() if v[i] != "-")
        assert (bad + 0.005 * weight) / (cast + weight) == pytest.approx(on_good[i], abs=1e-6)


def test_quality(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in found if r.quality], [r for r in found if not r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.95 and sum(r.kept for r in bad) / len(bad) < 0.1
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in found)
    odd = quality.judge(odd_documents).collect()
    assert len(odd) == 12 and not any(r.kept for r in odd if r.doc_id in (2, 3, 7))
    assert quality.judge(no_documents).count() == 0

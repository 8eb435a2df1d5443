import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import language_id as lid
from wayfold.llm.language_id import Ftrl, LanguageModel, document_frequencies, fit, grams, held_out, identify, letters, softmax, temperature, training_sample


def cell(gram):
    """An n-gram's cell in plain integers."""
    h = 0
    for c in gram:
        h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
    return ((h ^ (h >> 29)) >> 7) & (lid.CELLS - 1)


def spaced(text):
    out = "".join(c if c.isalpha() or ord(c) == 0x301 else " " for c in text.lower())
    return " " + " ".join(out.split()) + " "


TEXTS = ["Die Straße", "a", "  Étude -- 42 x!!", "日本 語😀", "ab " * 40, "x-y" * 30_000]


@pytest.mark.parametrize("text", TEXTS)
def test_grams_by_slicing(text, monkeypatch):
    plain = spaced(text)
    assert "".join(map(chr, letters(text))) == plain
    times = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    want = Counter()
    for gram, k in times.items():
        want[cell(gram)] += k
    assert dict(zip(*(x.tolist() for x in grams(text)), strict=True)) == want
    monkeypatch.setattr(lid, "CELLS", lid.CELLS)
    monkeypatch.setattr(lid, "SPAN", 5000)
    assert dict(zip(*(x.tolist() for x in grams(text)), strict=True)) == want


def test_no_letters():
    for text in (None, "", " \n", "42 :-) …", "́", "😀"):
        assert not len(letters(text))
        assert not len(grams(text)[0])
        assert LanguageModel(["de"]).predict(text) == ("und", 0.0)


def test_ftrl_against_plain_loops():
    """The same steps a number at a time."""
    rng, f = np.random.default_rng(3), Ftrl(0.3, 0.7, 0.2, 0.05)
    z, n = np.zeros((9, 3)), np.zeros((9, 3))
    zs, ns = [[0.0] * 3 for _ in range(9)], [[0.0] * 3 for _ in range(9)]
    for _ in range(60):
        at = np.sort(rng.choice(9, 4, replace=False))
        x, y = rng.normal(size=4), int(rng.integers(3))
        w = {}
        for i in at:
            for k in range(3):
                s = zs[i][k]
                w[i, k] = 0.0 if abs(s) <= f.l1 else -(s - math.copysign(f.l1, s)) / ((f.beta + math.sqrt(ns[i][k])) / f.alpha + f.l2)
        out = [sum(w[i, k] * v for i, v in zip(at, x, strict=True)) for k in range(3)]
        total = sum(map(math.exp, out))
        for i, v in zip(at, x, strict=True):
            for k in range(3):
                g = (math.exp(out[k]) / total - (k == y)) * v
                sigma = (math.sqrt(ns[i][k] + g * g) - math.sqrt(ns[i][k])) / f.alpha
                zs[i][k] += g - sigma * w[i, k]
                ns[i][k] += g * g
        f.step(z, n, at, x, y)
    assert np.allclose(z, zs)
    assert np.allclose(n, ns)
    assert (f.weights(z, n) == 0).any()
    assert np.all((f.weights(z, n) == 0) == (np.abs(z) <= f.l1))


def test_temperature_is_the_best_divisor():
    rng = np.random.default_rng(5)
    true = rng.normal(size=(4000, 4)) * 2
    y = np.array([rng.choice(4, p=p) for p in softmax(true)])
    assert temperature(true * 3, y) == pytest.approx(3.0, rel=0.1)
    assert temperature(true / 2, y) == pytest.approx(0.5, rel=0.1)
    sure = np.eye(3)[[0, 1, 2, 0]]
    assert 0.02 < temperature(sure, np.array([0, 1, 2, 0])) < 1


def test_document_frequencies(docs):
    n, df = document_frequencies(docs)
    texts = [r.text for r in docs.collect()]
    plain = [spaced(t) for t in texts]
    want = Counter(c for t in plain for c in {cell(g) for g in {t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)}})
    assert n == len(texts)
    assert {c: int(v) for c, v in enumerate(df) if v} == want


def test_sample_is_bounded_and_takes_least_hashes(spark):
    df = spark.range(3000).selectExpr("IF(id % 10 = 0, 'xx', 'yy') AS lang", "concat('text ', id DIV 2) AS text")
    got = training_sample(df, 100).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("m")).collect()
    assert {(r.lang, r.n, r.m) for r in got} == {("xx", 100, 100), ("yy", 100, 100)}
    least = df.where("lang = 'yy'").select("lang", "text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(100).collect()
    assert {r.text for r in training_sample(df, 100).where("lang = 'yy'").collect()} == {r.text for r in least}


def test_held_out_accuracy_and_partitions(docs):
    parted = docs.withColumn("held", held_out())
    train, rest = parted.where("NOT held").select("text", "lang"), parted.where("held")
    model = fit(train)
    got = identify(rest, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5  # sparse
    again = fit(train.repartition(7))
    assert again.languages == model.languages == ["de", "en", "es", "fr"]
    assert np.allclose(again.weights, model.weights)
    assert again.temperature == pytest.approx(model.temperature, rel=1e-6)


def test_scores_are_the_share_of_right_answers(spark):
    """Texts of one word that both languages use: no answer can be sure of itself."""
    letter = "chr(CAST(97 + pmod(hash(id, {}), 26) AS INT))"
    df = spark.range(4000).selectExpr("id", f"concat('wort', {', '.join(letter.format(i) for i in range(4))}) AS text", "IF(pmod(hash(id), 10) < 7, 'aa', 'bb') AS lang")
    got = identify(df.where("id >= 2000"), fit(df.where("id < 2000"))).collect()
    right, score = np.mean([r.lang == r.lang_pred for r in got]), np.mean([r.score for r in got])
    assert score == pytest.approx(right, abs=0.08)


def test_odd_rows(odd_docs, no_docs, spark):
    named = odd_docs.withColumnsRenamed({"size": "lang_pred"})
    model = fit(odd_docs)
    assert model.languages == ["de", "en", "fr"]
    got = identify(named, model)
    assert got.columns == [c for c in named.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (r.text is None or not any(c.isalpha() for c in r.text)) for r in rows)
    assert fit(no_docs).languages == []
    assert {r.lang_pred for r in identify(odd_docs, fit(no_docs)).collect()} == {"und"}
    assert identify(no_docs, model).count() == 0
    one = fit(odd_docs.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in identify(odd_docs.where("text like '%w%'"), one).collect()} == {("de", 1.0)}
    assert [r.h for r in spark.createDataFrame([(None,), (0,), (2,)], "doc_id long").select(held_out().alias("h")).collect()].count(None) == 0

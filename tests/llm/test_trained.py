"""Toxicity, language and quality: held-out accuracy on planted rules, what they locate, awkward inputs."""

import binascii
import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import language as LG
from paperloom.llm import quality as QU
from paperloom.llm import toxicity as TX
from paperloom.llm import training as TR

RND = random.Random(11)
VOWELS = {"en": ["the", "and", "ing", "ough", "sh"], "de": ["sch", "ein", "ung", "der", "ö"], "fr": ["eau", "que", "é", "ou", "ais"]}


def _word(lang="en"):
    return "".join(RND.choice(VOWELS[lang]) for _ in range(RND.randint(1, 3)))


def _text(lang="en", n=None):
    return " ".join(_word(lang) + RND.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n or RND.randint(20, 120)))


def _held_out(i, folds, fold):
    return binascii.crc32(str(i).encode()) % folds == fold


def test_area_under_curve():
    assert TR.area_under_curve(np.array([0.1, 0.4, 0.35, 0.8]), np.array([0, 0, 1, 1])) == 0.75
    assert TR.area_under_curve(np.array([0.5, 0.5, 0.5]), np.array([0, 1, 1])) == 0.5


def test_sample_skips_long_texts_and_keeps_both_labels(spark):
    ids = [r.id for r in spark.range(300).orderBy(F.xxhash64(F.lit("sample"), "id")).collect()]
    known = spark.createDataFrame([(i, int(k % 10 == 9)) for k, i in enumerate(ids)], "id long, y int")
    size = lambda k: 50_000 if k == 0 else 9_000 if k < 6 else 20
    docs = spark.createDataFrame([(i, "x" * size(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    sample = TR.training_sample(docs, known, chars=10_000)
    assert len(sample) == 294 and sum(y for _, y in sample) == 30 and sum(len(t) for t, _ in sample) <= 10_000
    rare = spark.createDataFrame([(i, int(k == 299)) for k, i in enumerate(ids)], "id long, y int")
    assert sorted(y for _, y in TR.training_sample(docs, rare, limit=20)) == [0] * 19 + [1]
    first = spark.createDataFrame([(i, int(k == 0)) for k, i in enumerate(ids)], "id long, y int")
    assert {y for _, y in TR.training_sample(docs, first, chars=10_000)} == {0, 1}


def _toxic_rows(n=900):
    rows = []
    for i in range(n):
        text = _text()
        if i % 5 == 0:
            at = RND.randint(0, len(text))
            text = text[:at] + RND.choice([" you zorgling. ", " zorgs ", " vile! "]) + text[at:]
        rows.append((i, text, int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = TX.train_toxicity(docs, labels)
    scored = {r.doc_id: r.toxicity for r in TX.score_toxicity(docs, model).collect()}
    test = [(scored[i], y, t) for i, t, y in rows if _held_out(i, 3, 1)]
    assert TR.area_under_curve(np.array([s.score for s, _, _ in test]), np.array([y for _, y, _ in test])) > 0.97
    assert np.mean([(s.score >= TX.TOXIC_FROM) == y for s, y, _ in test]) > 0.93
    located = [t[x.start : x.start + x.length] for s, y, t in test if y and s.score > 0.9 for x in s.sentences]
    assert located and np.mean(["zorg" in x or "vile" in x for x in located]) > 0.9


def test_toxicity_uses_no_held_out_label(spark):
    rows = [(i, "bad thing" if _held_out(i, 3, 1) else "good thing", int(_held_out(i, 3, 1))) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = TR.training_sample(docs, TR.labelled(labels, "toxic", folds=3, fold=1))
    assert found == [("good thing", 0)] * sum(not _held_out(i, 3, 1) for i in range(60))


def test_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(300)], "id long, y int")
    sample = TR.training_sample(docs, known, limit=30)
    assert len(sample) == 30 and all(t == f"text {t.split()[1]} " * 50 and int(t.split()[1]) % 2 == y for t, y in sample)
    assert TR.training_sample(docs.repartition(7), known, limit=30) == sample
    assert len(TR.training_sample(docs, known, chars=2000)) in (3, 4, 5) and TR.training_sample(docs.limit(0), known) == []


def test_models_without_labels():
    assert TX.fit_toxicity([]).scorer()("anything")[0] < 1e-6 and TX.fit_toxicity([("a", 1)]).scorer()("a b")[0] > 0.99
    assert QU.fit_quality([]).scores(QU.document_features("x"), np.array([0]))[0][0] == 0.5
    model = LG.LanguageModel.from_counts([], np.zeros((LG.BUCKETS, 0)))
    assert model.mixtures(["abc"], LG.letter_table())[0].shape == (1, 0)


def test_quality_on_held_out_rows(spark):
    rows = []
    for i in range(500):
        text = _text()
        if i % 4 == 0:
            text = RND.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: " ".join([_word()] * 60)])(text)
        rows.append((i, text, int(i % 4 != 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = QU.train_quality(docs, labels)
    scored = {r.doc_id: r.quality for r in QU.score_quality(docs, model).collect()}
    test = [(scored[i], y, t) for i, t, y in rows if _held_out(i, 5, 0)]
    assert TR.area_under_curve(np.array([s.score for s, _, _ in test]), np.array([y for _, y, _ in test])) > 0.98
    for s, _, t in test:
        assert abs(sum(p.weight for p in s.passages) - 1) < 1e-6 and "".join(t[p.start : p.start + p.length] for p in s.passages) == t


def test_quality_gradients():
    """A few steps lower the loss, and attention finds the one bad passage."""
    good, bad = "fine words here and there " * 16, "BAD!! " * 80
    sample = [(good * 5, 1)] * 20 + [(good * 2 + bad + good * 2, 0)] * 20
    model = QU.fit_quality(sample, steps=200)
    x = QU.document_features(good * 2 + bad + good * 2)
    scores, weights = model.scores(x, np.array([0]))
    assert scores[0] < 0.1 < 0.9 < model.scores(QU.document_features(good * 5), np.array([0]))[0][0]
    assert weights.argmax() == 2


def test_languages_and_mixtures(spark):
    rows = [(i, _text(lang), lang) for i, lang in enumerate(RND.choice(list(VOWELS)) for _ in range(400))]
    docs = spark.createDataFrame([*rows, (1000, "the and", None), (None, "the", "xx")], "doc_id long, text string, lang string").repartition(3)
    model = LG.train_languages(docs)
    assert model.languages == ["de", "en", "fr"]
    found = {r.doc_id: r.language for r in LG.identify_languages(docs, model).collect()}
    test = [(found[i], lang) for i, _, lang in rows if _held_out(i, 4, 2)]
    assert np.mean([f.lang == lang for f, lang in test]) > 0.98
    assert np.mean([len(f.shares) == 1 for f, _ in test]) > 0.95
    mixed = _text("de", 150) + " " + _text("fr", 60)
    share = model.mixtures([mixed], LG.letter_table())[0][0]
    assert share[0] > share[2] > 0.1 and share[1] == 0 and abs(share.sum() - 1) < 1e-5

    # a short passage of a very long text is found where its gain in likelihood exceeds the penalty
    for words, passage in ((20_000, 150), (20_000, 180), (2_000, 30)):
        share = model.mixtures([f"{_text('de', words // 2)} {_text('en', passage)} {_text('de', words // 2)}"], LG.letter_table())[0][0]
        assert 0 < share[1] < 0.05 and share[0] > 0.95
    assert (model.mixtures([_text("de", 20_000)], LG.letter_table())[0][0] > 0).tolist() == [True, False, False]


def test_mixture_of_a_text_does_not_depend_on_its_neighbours():
    counts = np.random.default_rng(1).integers(0, 50, (LG.BUCKETS, 3)).astype(float)
    model, letters = LG.LanguageModel.from_counts(["a", "b", "c"], counts), LG.letter_table()
    texts = ["some words", "", "123 !?", "x", "more \x00 words ÉÀ", "ab"]
    together = model.mixtures([t.replace("\x00", " ") for t in texts], letters)
    for k, t in enumerate(texts):
        alone = model.mixtures([t.replace("\x00", " ")], letters)
        assert np.allclose(alone[0][0], together[0][k], atol=1e-5) and abs(alone[1][0] - together[1][k]) < 1e-5


def test_trained_operators_on_awkward_rows(awkward):
    df = awkward.withColumn("toxicity", F.lit(1)).withColumn("Quality", F.lit(2)).withColumn("language", F.lit(3))
    letters_only = LG.LanguageModel.from_counts(["en"], np.ones((LG.BUCKETS, 1)))
    toxic = TX.score_toxicity(df, TX.ToxicityModel(-5.0, {"a": 9.0})).collect()
    assert [r.toxicity for r in toxic] == [1] * 8
    assert all((r.toxicity_.score > 0.9) == (r.text == "a b c") and (r.text or r.toxicity_.score == 0) for r in toxic)
    good = QU.score_quality(df, QU.fit_quality([("a b c", 1), ("!!", 0)])).collect()
    assert all(0 <= r.quality_.score <= 1 and len(r.quality_.passages) == max(1, -(-len((r.text or "").split()) // QU.PASSAGE)) for r in good)
    found = LG.identify_languages(df, letters_only).collect()
    assert all((r.language_.lang == "und" and r.language_.score == 0) if not (r.text or "").strip() else r.language_.lang == "en" for r in found)
    empty = df.limit(0)
    assert TX.score_toxicity(empty, TX.ToxicityModel()).count() == 0 and LG.identify_languages(empty, letters_only).count() == 0
    assert QU.score_quality(empty, QU.QualityModel(0.5)).count() == 0 and LG.train_languages(empty.drop("language")).languages == []

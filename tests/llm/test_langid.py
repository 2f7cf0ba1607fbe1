import math

import numpy as np
from pyspark.sql import functions as F

from chalkline.llm import langid
from chalkline.llm.common import tokenizer_file


def test_forward_sums_all_segmentations():
    vocabulary = langid.load_vocabulary(tokenizer_file(langid.VOCABULARY))
    rng = np.random.default_rng(1)
    p = rng.random((len(vocabulary.pieces), 2)) / 100

    def brute(text, lang):
        if not text:
            return 1.0
        total, single = 0.0, False
        for k in range(1, len(text) + 1):
            i = vocabulary.ids.get(text[:k])
            if i is not None:
                total += p[i, lang] * brute(text[k:], lang)
                single = single or k == 1
        return total if single else total + langid.UNKNOWN * brute(text[1:], lang)

    words = ["the", "aqua", "straße", "xyzzy", "長文", "a"]
    scores = langid.word_scores(words, vocabulary, p)
    for w, s in zip(words, scores):
        for lang in (0, 1):
            assert math.isclose(s[lang], math.log(brute(langid.WORD_MARK + w, lang)), rel_tol=1e-9)
    # the rescaled form for long words agrees
    for w in words:
        assert np.allclose(langid.long_word(w, vocabulary, p), scores[words.index(w)])


def test_held_out_accuracy(spark, sample):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(sample.filter(langid.fold(F.col("doc_id")) != 1), train_docs=100, rounds=2)
    held = langid.predict(sample.filter((langid.fold(F.col("doc_id")) == 1) & F.col("lang").isNotNull()), model)
    rows = held.select("lang", "lang_pred", "lang_score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_messy_and_rejection(spark, messy, sample, empty_docs):
    model = langid.train(sample, train_docs=50, rounds=1)
    rows = langid.predict(messy, model).select("doc_id", "text", "lang_pred", "lang_score").collect()
    assert len(rows) == messy.count()
    for r in rows:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.langs and 0 < r.lang_score <= 1
    kept = langid.keep_known(messy, model, 0.0)
    assert kept.columns == messy.columns
    assert kept.filter("text is null or text = '' or text = '1234 5678 !!'").count() == 0
    assert kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert langid.predict(empty_docs, model).count() == 0
    nothing = langid.train(empty_docs)
    assert {r.lang_pred for r in langid.predict(messy, nothing).collect()} == {"und"}
    # an output column that the input has already is replaced
    again = langid.predict(langid.predict(messy, model), model)
    assert again.columns.count("lang_pred") == 1


def test_words():
    assert langid.words_of("Ab1c d_E ²x Ⅷ") == ["ab", "c", "d", "e", "x"]
    assert langid.words_of(None) == []

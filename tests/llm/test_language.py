"""Language models against sums over written-out segmentations, and by accuracy on rows held out."""

import math
import zlib

import hard
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from plumbline.llm import language
from plumbline.llm.pieces import SPACE, alike, pieces_of

PIECES = pieces_of(public_tokenizers.path(language.VOCABULARY))
NUMBER = {text: i for i, text in enumerate(PIECES.texts)}


def ways(word):
    """All segmentations as lists of piece numbers; None is a character that is no piece."""
    if not word:
        return [[]]
    found = []
    for n in range(1, len(word) + 1):
        known = NUMBER.get(word[:n])
        if known is not None or n == 1:
            found += [[known, *rest] for rest in ways(word[n:])]
    return found


@pytest.fixture(scope="module")
def probability():
    p = np.random.default_rng(2).random((len(PIECES), 3))
    return p / p.sum(axis=0)


WORDS = [SPACE, SPACE + "the", SPACE + "théâtre", SPACE + "ꙮa", SPACE + "being", "a", SPACE + "ing" * 3]


def test_likelihood_sums_over_segmentations(probability):
    got = language.log_likelihoods(PIECES, language.scaled(PIECES, probability), WORDS)
    for word, row in zip(WORDS, got, strict=True):
        total = sum(
            math.prod(probability[i, 1] if i is not None else language.UNKNOWN for i in way) for way in ways(word)
        )
        assert row[1] == pytest.approx(math.log(total), rel=1e-9)


def test_long_words_stay_in_range(probability):
    weights = language.scaled(PIECES, probability)
    short, long = language.log_likelihoods(PIECES, weights, [SPACE + "ab" * 40, SPACE + "ab" * 4000])
    assert np.isfinite(long).all() and (long < short * 80).all() and (long > short * 130).all()


def test_expectations(probability):
    counts = np.arange(1.0, len(WORDS) + 1)
    langs = np.array([0, 1, 2, 0, 1, 2, 1])
    got = language.expectations(PIECES, language.scaled(PIECES, probability), WORDS, langs, counts)
    want = np.zeros((len(PIECES) + 1, 3))
    for word, lang, n in zip(WORDS, langs, counts, strict=True):
        each = [(w, math.prod(probability[i, lang] if i is not None else language.UNKNOWN for i in w)) for w in ways(word)]
        total = sum(p for _, p in each)
        for way, p in each:
            for i in way:
                if i is not None:
                    want[i, lang] += n * p / total
    assert np.allclose(got, want)


def test_words_of_like_lengths_cover_all():
    words = ["x" * n for n in (0, 5, 1, 1, 300, 7, 2, 100000)]
    assert sorted(i for part in alike(words, 50) for i in part) == list(range(len(words)))


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = entry.queries()["op9_language"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_hard_documents(spark):
    docs = hard.documents(spark)
    model = language.train(docs)
    assert model.languages == ["en", "fr"] and np.allclose(model.probability.sum(axis=0), 1)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r, d in zip(rows, docs.collect(), strict=True):
        letters = any(language.letter_runs(w) for w in language.raw_words(d.text))
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
    kept = language.recognised(docs, model)
    assert kept.schema.simpleString() == docs.schema.simpleString() and 0 < kept.count() < docs.count()
    assert language.predict(hard.none(spark), model).count() == 0
    untaught = language.train(hard.none(spark))
    assert {r.lang_pred for r in language.predict(docs, untaught).collect()} == {"und"}
    assert language.recognised(docs, untaught).count() == 0

"""Token files against the tokenizers library, and the blocks by round trips."""

import random
import zlib

import hard
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from plumbline.llm import pfor, tokenfiles
from plumbline.session import scratch_folder

MODEL = public_tokenizers.path(tokenfiles.VOCABULARY)
LIBRARY = Tokenizer.from_file(MODEL)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, tokenfiles.END]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=40), st.integers(1, 90), st.floats(0.01, 1))
def test_blocks_round_trip(values, times, percentile):
    values = np.array(values * times, dtype=np.uint32)
    blocks = pfor.pack(values, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert np.array_equal(pfor.unpack(b"".join(blocks), starts), values)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("aZé' sS.9!<|>ßİ\x1c\x85 ", max_size=30))
def test_encoder_equals_library(text):
    flat, counts = tokenfiles.encoder_of(MODEL).encode(pa.array([text]))
    assert flat.tolist() == library_ids(text) and counts.tolist() == [len(flat)]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b", "I'll we've 's'S DON'T", "́a ́b"])
def test_special_texts(text):
    assert tokenfiles.encoder_of(MODEL).encode(pa.array([text]))[0].tolist() == library_ids(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.none() | st.text("ab \t\x1c\x85é,.'9", max_size=12), max_size=9))
def test_several_texts(texts):
    flat, counts = tokenfiles.encoder_of(MODEL).encode(pa.array(texts, type=pa.string()))
    want = [library_ids(x) for x in texts]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_another_vocabulary_is_not_taken_word_by_word():
    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokenfiles.Encoder(file), Tokenizer.from_file(file)
    texts = ["Two  words, don't\n\nsplit them", None, "x"]
    flat, counts = encoder.encode(pa.array(texts))
    want = [[*library.encode(x or "", add_special_tokens=False).ids, tokenfiles.END] for x in texts]
    assert not encoder.by_word and tokenfiles.encoder_of(MODEL).by_word
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokenfiles, "WORDS_KEPT", 3)
    encoder = tokenfiles.Encoder(MODEL)
    for text in ["one two three four", "five, six", "one two", ""]:
        assert encoder.encode(pa.array([text]))[0].tolist() == library_ids(text)


def test_bases_over_thousands_of_files(spark):
    table = spark.range(5000).selectExpr("cast(id AS string) AS file", "id * 3 AS place", "id % 7 AS tokens")
    found = {int(r.file): r.base for r in tokenfiles.bases(table).collect()}
    assert found == {i: sum(j % 7 for j in range(i)) for i in range(5000)}


def expected(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    found, start = [], 0
    for doc_id, text in rows:
        ids = np.array(library_ids(text), dtype="<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(found, key=repr)


@pytest.mark.parametrize("size", [10**9, 3000])
def test_hard_documents(spark, monkeypatch, size):
    monkeypatch.setattr(tokenfiles, "TEXT_IN_FILE", size)
    docs = hard.documents(spark)
    assert hard.rows_of(tokenfiles.report(docs)) == expected(docs)
    assert tokenfiles.report(hard.none(spark)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert hard.rows_of(entry.queries()["op5_token_files"](spark, FOLDER)) == expected(docs)


def test_any_stretch_and_strangers_in_the_folder(spark):
    folder = scratch_folder(spark, "ids")
    docs = hard.documents(spark)
    tokenfiles.write(docs, folder)
    with open(f"{folder}/ids/00000000-left-behind.pfor", "wb") as half:
        half.write(b"PFORIDS1 half")
    assert tokenfiles.read(spark, folder).count() == docs.count()
    with pytest.raises(ValueError):
        tokenfiles.Reader(f"file://{folder}/ids", "00000000-left-behind.pfor")
    for row in spark.read.parquet(f"{folder}/files").collect():
        reader = tokenfiles.Reader(f"file://{folder}/ids", row.file)
        every = reader.ids(0, reader.tokens)
        pick = random.Random(1)
        for _ in range(20):
            start = pick.randrange(reader.tokens)
            count = pick.randrange(reader.tokens - start + 1)
            assert np.array_equal(reader.ids(start, count), every[start : start + count])

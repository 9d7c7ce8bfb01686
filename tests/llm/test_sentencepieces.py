"""N-best segmentations against all segmentations, and round trips."""

import random
from itertools import product

import hard
import public_tokenizers
import pytest
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import sentencepieces as sp
from plumbline.llm.pieces import SPACE, pieces_of

MODEL = public_tokenizers.path(sp.VOCABULARY)
LATTICE = sp.Lattice(pieces_of(MODEL))


def ways(word):
    if not word:
        return [0.0]
    found = []
    for n in range(1, len(word) + 1):
        known = LATTICE.number.get(word[:n])
        if known is not None:
            found += [float(LATTICE.scores[known]) + rest for rest in ways(word[n:])]
        elif n == 1:
            found += [LATTICE.low + rest for rest in ways(word[1:])]
    return found


def words(number, letters, longest, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(letters) for _ in range(pick.randrange(longest))) for _ in range(number)]


def test_search_finds_the_best_in_order():
    for word in words(150, "thernsa é日", 10, 1):
        word = SPACE + word.replace(" ", "")
        found = LATTICE.search(word, 5)
        assert [s for s, _ in found] == pytest.approx(sorted(ways(word), reverse=True)[:5])
        assert len({tuple(ids) for _, ids in found}) == len(found)
        flat, counts, top, gap = LATTICE.best([word])
        assert flat.tolist() == found[0][1] and top[0] == found[0][0]
        assert gap[0] == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))


def test_whole_texts():
    encoder = sp.Encoder(MODEL, 4)
    for text in words(120, "the an\n▁x  ", 10, 2):
        each = [[LATTICE.low] if c == sp.MARK else ways(c) for c in sp.chunks(text)]
        totals = sorted((sum(x) for x in product(*each)), reverse=True)[:4]
        found = encoder.encode([text])[0]
        assert [s for s, _ in found] == pytest.approx(totals)
        assert all(encoder.decode(ids) == text for _, ids in found)
        assert len({ids for _, ids in found}) == len(found)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t for t in hard.texts() if t and len(t) < 4000]
    monkeypatch.setattr(sp, "CHUNKS_KEPT", 3)
    one, all_ = sp.Encoder(MODEL, 4), sp.Encoder(MODEL, 4)
    assert [one.encode([t])[0] for t in texts] == all_.encode(texts)


def test_hard_documents(spark):
    docs = hard.documents(spark)
    encoded = sp.encode(docs)
    assert encoded.count() == docs.count() and encoded.where("NOT restored").count() == 0
    ids = encoded.selectExpr("doc_id", "segmentations[0].ids AS ids")
    expected = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert hard.rows_of(sp.decode(ids)) == expected
    assert sp.encode(hard.none(spark)).count() == 0


def test_query(spark):
    rows = entry.queries()["op4_sentencepiece_n_best"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.restored and r.scores == sorted(r.scores, reverse=True) for r in rows)

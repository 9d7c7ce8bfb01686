"""The audit of sources against plain counting with exact numbers."""

import re
from collections import Counter, defaultdict

import hard
import numpy as np
import pyarrow as pa
import pytest
from conftest import FOLDER
from oracle import connect, duck_table, spark_table

import __spark_entry__ as entry
from plumbline.llm import divergence


def plain(rows, least=30, ranks=50):
    """Rows ``(text, lang, source)``."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        n[lang, source].update(terms)
        held[lang].update(set(terms))
        groups[lang].add(source)
    found = []
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least]
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= ranks]
    return sorted(found, key=repr)


def some_documents(sources=7):
    pick = np.random.default_rng(8)
    words = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "Été", "ſtraße", "日本", "\U0001f44d"]
    rows = []
    for i in range(400):
        lang = ["en", "fr", None, ""][i % 4 if i % 3 else 0]
        weights = 1 / (1 + np.arange(len(words)) * (1 + i % sources))
        chosen = pick.choice(words, int(pick.integers(0, 60)), p=weights / weights.sum())
        rows.append((" ".join(map(str, chosen)).title() if i % 5 else ", ".join(map(str, chosen)), lang, None if i % 11 == 0 else f"s{i % sources}"))
    return [*rows, (None, "en", "empty"), ("", "xx", "a"), ("rare words", "xx", "b"), ("12 34", None, "only")]


@pytest.mark.parametrize("tile", [256, 2])
def test_against_counting(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", 40)
    rows = some_documents()
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, n long")
    for least, ranks in ((30, 50), (3, 4)):
        want = plain(rows, least, ranks)
        assert {r[2] for r in want} == {"pair", "term"}
        assert hard.rows_of(divergence.report(df, least, ranks)) == want


def test_counting_in_few_words(monkeypatch):
    rows = [(lang or "", source or "", text) for text, lang, source in some_documents()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 50], strict=True)], names=["lang", "source", "text"]) for i in range(0, len(rows), 50)]

    def totals():
        found = defaultdict(lambda: np.zeros(2, dtype=int))
        got = list(divergence.counted(batches))
        for batch in got:
            for lang, source, term, n, documents in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found[lang, source, term] += (n, documents)
        return {k: tuple(v) for k, v in found.items()}, len(got)

    want, once = totals()
    monkeypatch.setattr(divergence, "WORDS_KEPT", 5)
    got, often = totals()
    assert got == want and often > once


def test_counts_too_large_for_64_bits(spark):
    row = spark.createDataFrame([(10**14, 3 * 10**14, 10**6)], "n long, total long, terms long")
    got = row.select(divergence.share(*map(divergence.column, ("n", "total", "terms")))).first()[0]
    assert got == 1 + 10**9 * (10**14 + 5) // (3 * 10**14 + 5 * 10**6)


def test_hard_documents(spark):
    docs = hard.documents(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 3, 30):
        assert hard.rows_of(divergence.report(docs, least)) == plain(rows, least)
    assert divergence.report(hard.none(spark)).count() == 0


def test_query(spark):
    name = "op13_source_divergence"
    found = spark_table(entry.queries()[name](spark, FOLDER))
    assert found == duck_table(connect(FOLDER), entry.oracle_sql()[name])
    assert found[1]

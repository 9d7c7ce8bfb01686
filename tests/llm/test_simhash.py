"""SimHash against its definition, and components against a plain search."""

import hard
import numpy as np
import xxhash
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import simhash
from plumbline.llm.components import components


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, most=3):
    ids = [d for d, _ in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(pairs)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(pairs))]


def check(df, docs):
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    expected = [(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, plain_components(rows), strict=True)]
    assert hard.rows_of(df) == sorted(expected, key=repr)


def test_hard_documents(spark):
    docs = hard.documents(spark)
    check(simhash.report(docs), docs)
    assert simhash.report(hard.none(spark)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check(entry.queries()["op3_simhash_near_copies"](spark, FOLDER), docs)


def test_links_join_what_all_close_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    pick = np.random.default_rng(3)
    centres = pick.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            flips = pick.choice(64, pick.integers(1, 5), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    expected = plain_components([(simhash.signed(p), p) for p in prints])
    assert [found.get(simhash.signed(p), simhash.signed(p)) for p in prints] == expected


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500), (900, 901), (901, 900)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_first_of_each(spark):
    docs = hard.documents(spark)
    kept = simhash.first_of_each(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    expected = [d for (d, _), c in zip(rows, plain_components(rows), strict=True) if d == c]
    # Rows of equal fingerprints without a doc_id are one group, and stay only where no other is in it.
    assert sorted({r.doc_id for r in kept.collect()} - {None}) == sorted(set(expected) - {None})
    assert kept.count() == len(set(plain_components([(i, fp) for i, (_, fp) in enumerate(rows)])))
    assert simhash.first_of_each(hard.none(spark)).count() == 0


def test_rows_not_ids_decide_who_stays(spark):
    copy = " ".join(f"word{i}" for i in range(400))
    near, other = copy + " more", " ".join(f"thing{i}" for i in range(300))
    third = " ".join(f"third{i}" for i in range(300))
    rows = [(1, copy, 1), (2, near, 2), (2, other, 3), (2, other, 3), (None, third, 4), (None, third, 4), (None, near, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body long")
    assert simhash.links(simhash.fingerprints(docs).select("fp").distinct()).count()
    kept = simhash.first_of_each(docs)
    assert hard.rows_of(kept) == hard.rows_of(spark.createDataFrame([rows[0], rows[2], rows[4]], docs.schema))
    many = spark.createDataFrame([(i % 3, copy if i % 2 else None) for i in range(2000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_each(many).collect()) == [0, 0]

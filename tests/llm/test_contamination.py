"""Benchmark passages against plain edit distances."""

import random

import hard
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import contamination as c


def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(words, edits, pick, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = pick.randrange(len(words))
        how = pick.randrange(3)
        if how == 0:
            words[at] = pick.choice(vocabulary)
        elif how == 1:
            words.insert(at, pick.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return words


def test_every_found_place_and_nearly_every_place_is_found():
    pick = random.Random(9)
    vocabulary = [f"w{i}".encode() for i in range(400)] + [b"the", b"of"] * 60
    items = [[pick.choice(vocabulary) for _ in range(n)] for n in (1, 2, 4, 5, 9, 15, 20, 31, 44, 60) for _ in range(3)]
    finder = c.Finder([(i, b" ".join(x).decode()) for i, x in enumerate(items)])
    texts = []
    for _ in range(400):
        item = pick.randrange(9, len(items))
        body = edited(items[item], pick.randrange(len(items[item]) // 5 + 3), pick, vocabulary)
        around = [[pick.choice(vocabulary) for _ in range(pick.randrange(30))] for _ in range(2)]
        texts.append(around[0] + body + around[1])
    got = finder.search([b" ".join(t).decode() for t in texts])
    found = {(int(t), int(i)): int(d) for t, i, d in zip(got["text"], got["item"], got["distance"], strict=True)}
    missed = total = 0
    for t, words in enumerate(texts):
        for i, item in enumerate(items):
            distance = plain_distance(item, words)
            if (t, i) in found:
                assert found[t, i] >= distance and found[t, i] <= len(item) // 5
            if distance <= len(item) // 5:
                total += 1
                missed += (t, i) not in found
                assert (t, i) in found or distance > 0
    assert total > 300 and missed <= total * 0.02


def test_spans():
    finder = c.Finder([(7, "Alpha, beta gamma delta epsilon zeta eta theta iota kappa")])
    got = finder.search(["x y alpha BETA gamma extra delta epsilon zeta eta theta iota kappa z", None, "", "alpha beta"])
    assert [got[k].tolist() for k in ("text", "distance", "start", "end")] == [[0], [1], [2], [13]]


def test_hard_tables(spark):
    docs = hard.documents(spark)
    texts = [t for t in hard.texts() if t]
    items = [(1, texts[5]), (2, None), (None, texts[6]), (4, ""), (5, texts[5]), (6, "nowhere to be found at all in any of them")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in c.contaminated(docs, items).collect()}
    for r in docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect():
        for item in items.collect():
            words, item_words = c.normal_words(r.text), c.normal_words(item.text)
            held = bool(item_words) and plain_distance(item_words, words) <= len(item_words) // 5
            assert ((r.doc_id, item.item_id) in got) == held, (r.doc_id, item.item_id)
    assert c.contaminated(hard.none(spark), items).count() == 0
    assert c.contaminated(docs, items.limit(0)).count() == 0


def test_clean_keeps_what_holds_nothing(spark):
    docs = hard.documents(spark)
    items = spark.createDataFrame([(1, hard.texts()[6])], "item_id long, text string")
    held = {r.doc_id for r in c.contaminated(docs, items).collect()}
    docs = docs.where("doc_id IS NOT NULL")
    kept = c.clean(docs, items)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert hard.rows_of(kept) == sorted((tuple(r) for r in docs.collect() if r.doc_id not in held), key=repr)


def test_blocks_hold_each_item_once(spark, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    monkeypatch.setattr(c, "WORDS_AT_ONCE", 300)
    blocks = list(c.blocks_of(items, "item_id", "text"))
    assert len(blocks) > 3 and sum(map(len, blocks)) == items.count()


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = [(i, c.normal_words(t)) for i, t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op10_benchmark_passages"](spark, FOLDER).collect()}
    exact = set()
    for r in docs:
        words = b" " + b" ".join(c.normal_words(r.text)) + b" "
        exact |= {(r.doc_id, i) for i, item in items if b" " + b" ".join(item) + b" " in words}
    assert exact and exact <= got

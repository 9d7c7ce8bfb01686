"""The language model: counts exactly, seating against the exact distribution, scores token by token."""

import math
import zlib
from collections import Counter, defaultdict

import hard
import numpy as np
import pytest
import xxhash
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import pitmanyor as py


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*(w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w), None]


def plain_counts(rows):
    """The columns of the contract that need no model, for rows ``(doc_id, text)``."""
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in plain_tokens(text))
    n, v = sum(c.values()), len(c)
    found = []
    for (i, text), h in zip(rows, held, strict=True):
        tokens = plain_tokens(text)
        base = sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in tokens)
        found.append((i, h, len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 6)))
    return sorted(found, key=repr)


def counts_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def test_hard_documents(spark):
    docs = hard.documents(spark)
    found = py.report(docs).cache()
    assert counts_of(found) == plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert found.where("isnan(score) OR score IS NULL OR score > 0").count() == 0
    assert py.report(hard.none(spark)).count() == 0
    nothing = docs.where(py.held_out(py.column("doc_id")))
    assert nothing.count() and [r.score for r in py.report(nothing).collect()] == [0.0] * nothing.count()


def test_query(spark):
    found = entry.queries()["op11_language_model"](spark, FOLDER).cache()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert counts_of(found) == plain_counts([tuple(r) for r in docs.collect()])
    held = found.where("held_out").selectExpr("sum(score)", "sum(base_score)", "count(*)").first()
    assert held[2] and held[0] > held[1]


def seat_numbers(c, d, weight):
    """The exact shares of 1 to ``c`` tables among the seatings of ``c`` customers."""
    ways = np.zeros((c + 1, c + 1))
    ways[1, 1] = 1
    for n in range(2, c + 1):
        for t in range(1, n + 1):
            ways[n, t] = ways[n - 1, t - 1] + (n - 1 - d * t) * ways[n - 1, t]
    share = np.array([ways[c, t] * math.prod(weight(j) for j in range(t)) for t in range(1, c + 1)])
    return share / share.sum()


@pytest.mark.parametrize("c", [2, 3, 5, 9])
@pytest.mark.parametrize("mass", [0.05, 0.6])
@pytest.mark.parametrize("party", [16, 1])
def test_seating_is_that_of_the_restaurant(monkeypatch, c, mass, party):
    """All at once, and one by one."""
    monkeypatch.setattr(py, "PARTY", party)
    n, d = 20_000, 0.6
    each = np.ones(n)
    opening = py.Opening(d, 3.0 * each, mass * each, 0.02, 0.0 * each, each)
    seats, pick = py.Seating(np.full(n, c)), np.random.default_rng(c)
    for _ in range(12):
        seats.sweep(seats.customers, opening, pick)
    if party == 1:
        ends = np.cumsum(seats.tables)
        assert np.array_equal(np.add.reduceat(seats.sizes, ends - seats.tables), np.full(n, c))
    got = np.bincount(seats.tables, minlength=c + 1)[1:] / n
    want = seat_numbers(c, d, lambda t: (py.STRENGTH + d * (3 + t)) * (mass + 0.02 * t))
    assert np.abs(got - want).max() < 0.02


def test_customers_come_and_go():
    pick = np.random.default_rng(1)
    n = 500
    opening = py.Opening(0.5, np.ones(n), np.full(n, 0.7), 0.0, np.zeros(n), np.ones(n))
    seats = py.Seating(pick.integers(1, 40, n))
    for _ in range(6):
        customers = pick.integers(1, 60, n)
        seats.sweep(customers, opening, pick)
        assert (seats.tables >= 1).all() and (seats.tables <= customers).all()
        sizes = seats.sizes_of(np.arange(n))
        assert np.array_equal(np.add.reduceat(sizes, np.cumsum(seats.tables) - seats.tables), customers) and (sizes > 0).all()
    heavy = py.Seating(np.array([10**7, 3]))
    met = set()
    for _ in range(10):
        heavy.sweep(heavy.customers, opening, pick)
        met.add(int(heavy.tables[0]))
        assert heavy.sizes.sum() == 10**7
    assert 1 < max(met) < 1000


def some_texts(n=60):
    pick = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)] + ["Naïve", "日本"]
    return [" ".join(words[min(41, int(x))] for x in pick.geometric(0.1, int(pick.integers(0, 40)))) for _ in range(n)]


def shards_of(model):
    found = []
    for row in model.rows.collect():
        states = []
        for i, shard in enumerate(py.seated(row["shard"], row.asDict(), model.totals[:-1], model.seed)):
            if i > len(model.totals) - 1 - py.AVERAGED:
                states.append(shard.sample(model.totals[i], model.totals[0].discounts()))
        found.append((shard, states))
    return found


def test_scores_token_by_token(spark, monkeypatch):
    rows = list(enumerate(some_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(py, "SHARD_CHARACTERS", 500)
    model = py.train(docs.where("doc_id % 3 > 0"))
    assert model.shards > 3
    shards = shards_of(model)
    tables = defaultdict(int)
    for shard, _ in shards:
        assert np.array_equal(np.bincount(shard.class_of, shard.seats2.tables), shard.seats1.customers)
        assert np.array_equal(np.bincount(shard.word_of, shard.seats1.tables), shard.seats0.customers)
        for context, t in zip(shard.contexts, shard.seats2.tables, strict=True):
            tables[int(context)] += int(t)
    assert {c: t for c, t in enumerate(model.totals[-1].tables2.tolist()) if t} == tables
    words = np.unique(np.concatenate([shard.words for shard, _ in shards]))
    assert len(words) == model.totals[0].scalars["words"]

    def probability(context, word):
        for shard, states in shards:
            if word in shard.words:
                break
        return shard.probabilities(np.array([word], dtype=np.uint64), np.array([1]), np.array([context], dtype=np.uint16), states)[0][0]

    def context_of(w):
        h = xxhash.xxh64_intdigest(w)
        return xxhash.xxh64_intdigest(w[-2:]) % py.CLASSES << py.WITHIN | h >> 64 - py.WITHIN

    for context in (context_of(b""), context_of(b"w1"), context_of(b"never seen")):
        assert abs(sum(probability(context, w) for w in words) + probability(context, 12345) - 1) < 1e-9
    found = {r.doc_id: r.score for r in py.score(docs, model).collect()}
    for i, text in rows[:25]:
        tokens = [b"", *((t.encode() if t else b"") for t in plain_tokens(text))]
        logs = [math.log10(probability(context_of(a), xxhash.xxh64_intdigest(b))) for a, b in zip(tokens, tokens[1:], strict=False)]
        assert abs(found[i] - math.fsum(logs)) < 1e-6


def test_blocks_and_repeats_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(2)
    once = hard.rows_of(py.report(docs))
    assert once == hard.rows_of(py.report(docs))
    batches = [docs.select("text").toArrow().to_batches()[0]]

    def counted():
        total = Counter()
        for row in py.rows_of(py.counting(3)(iter(batches))):
            words, sizes, contexts, counts = py.read(row, words=np.uint64, sizes=np.uint32, contexts=np.uint16, counts=np.int64)
            for key, n in zip(zip(np.repeat(words, sizes).tolist(), contexts.tolist(), strict=True), counts.tolist(), strict=True):
                total[key] += n
        return total

    want = counted()
    monkeypatch.setattr(py, "WORDS_KEPT", 10)
    monkeypatch.setattr(py, "BLOCK_TOKENS", 30)
    monkeypatch.setattr("plumbline.llm.words.CHARACTERS_AT_ONCE", 100)
    assert counted() == want

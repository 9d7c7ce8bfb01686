"""Neighbour search against brute force."""

import numpy as np
import pytest

import __spark_entry__ as entry
from plumbline.llm.neighbours import Index, Settings, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, rank string"


def table(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "r") for i, v in zip(ids or range(len(vectors)), vectors)]  # noqa: B905
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, vectors, query, k):
    score = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort([ids, -score]) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, vectors = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    rows = entry.queries()["op7_neighbours"](spark, folder).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for query in np.nonzero(ids % 20 == 0)[0]:
        got = rows[rows.query_id == ids[query]]
        assert got["rank"].tolist() == list(range(1, 21))
        best = brute(ids, vectors, query, 20)
        hits += len({i for i, _ in best} & set(got.vec_id))
        total += 20
        assert got.score.is_monotonic_decreasing
        for row in got.itertuples():
            assert row.score == pytest.approx(vectors[query] @ vectors[np.nonzero(ids == row.vec_id)[0][0]], abs=1e-12)
    assert hits >= 0.9 * total


def test_lengths_differ_and_shards_are_many(spark):
    pick = np.random.default_rng(5)
    vectors = (pick.normal(size=(700, 12)) * pick.uniform(0.1, 3, (700, 1))).astype(np.float32).astype(float)
    ids = np.arange(700)
    rows = nearest(table(spark, vectors), every=35, k=10, settings=Settings(shard=90, block=7)).collect()
    hits = 0
    for query in range(0, 700, 35):
        hits += len({i for i, _ in brute(ids, vectors, query, 10)} & {r.vec_id for r in rows if r.query_id == query})
    assert hits >= 0.9 * 200 and len(rows) == 200


def test_hard_vectors(spark):
    vectors = [[1, 0], [0.5, 0.5], [1, 0], [0, 0], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [1], [1, 0], [-1, 0], [2, 0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 2, 20, None]
    rows = nearest(table(spark, vectors, ids), settings=Settings(verified=1.0)).collect()
    got = {q: [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20)}
    assert got[0] == [(1, 2, 1.0), (2, 2, 1.0), (3, 1, 0.5), (4, 20, -1.0)]
    assert got[20] == [(1, 1, -0.5), (2, 0, -1.0), (3, 2, -1.0), (4, 2, -1.0)]
    assert len(rows) == 8
    assert nearest(table(spark, [])).count() == 0
    assert nearest(table(spark, [[1, 2]], [0])).count() == 0
    assert nearest(table(spark, [[1, 2], [2, 1]], [1, 3])).count() == 0


def test_equal_vectors_go_by_id(spark):
    vectors = [[0.3, 0.1, 0.7]] * 60
    rows = nearest(table(spark, vectors), every=60, k=20, settings=Settings(shard=16)).collect()
    assert sorted(r.vec_id for r in rows) == list(range(1, 21))


def test_copies_behind_the_nearest_do_not_end_the_search():
    hits, worst = 0, 10
    for seed in range(20):
        pick = np.random.default_rng(seed)
        vectors = pick.normal(size=(4096, 64))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        query = pick.normal(size=64)
        query /= np.linalg.norm(query)
        order = np.argsort(-(vectors @ query))
        vectors[order[-1365:]] = vectors[order[10]]
        got = Index(vectors, 1.0, Settings()).nearest(np.arange(4096), np.array([-1]), query[None], 20)
        found = len(set(order[:10]) & set(got["vec_id"]))
        hits, worst = hits + found, min(worst, found)
        assert len(got["vec_id"]) == 20
    assert hits >= 0.93 * 200 and worst >= 7


def test_small_tables_give_all_that_are_asked_for(spark):
    for n in (2, 10, 21, 30, 50, 66):
        vectors = np.random.default_rng(n).normal(size=(n, 64))
        length = np.linalg.norm(vectors, axis=1).max()
        got = Index(vectors, length, Settings()).nearest(np.arange(n), np.arange(n), vectors, 20)
        assert np.bincount(got["query_id"], minlength=n).tolist() == [min(20, n - 1)] * n
    vectors = [[1, 0], [0.5, 0.5], [1, 0], [-1, 0], [0.2, 3]]
    rows = nearest(table(spark, vectors, [0, 0, 0, 1, 2])).collect()
    assert sorted((r.rank, r.vec_id) for r in rows) == [(1, 2), (2, 1)]

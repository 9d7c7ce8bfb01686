"""Importance weights against plain sums, and the draw against a sort."""

import math

import hard
import numpy as np
import xxhash
from conftest import FOLDER
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.llm import resampling as r


def plain_buckets(text):
    words = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().translate(r.SIGNS).split()]
    pairs = [((a * int(r.PAIR) + b) % 2**64 >> 20) % r.BUCKETS for a, b in zip(words, words[1:], strict=False)]
    return [w % r.BUCKETS for w in words] + pairs


def test_weights(spark):
    docs = hard.documents(spark)
    targets = spark.createDataFrame([(6,), (7,), (7,), (99,), (None,)], "doc_id long")
    ratios = r.log_ratios(docs, targets)
    raw, aim = np.ones(r.BUCKETS), np.ones(r.BUCKETS)
    for d in docs.collect():
        for b in plain_buckets(d.text):
            raw[b] += 1
            aim[b] += d.doc_id in (6, 7)
    assert np.allclose(ratios[:-1], np.log(aim / aim.sum()) - np.log(raw / raw.sum()))
    got = hard.rows_of(r.log_weights(docs, ratios).select("doc_id", F.round("log_weight", 6)))
    want = [(d.doc_id, round(math.fsum(ratios[b] for b in plain_buckets(d.text)), 6)) for d in docs.collect()]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(got, sorted(want, key=repr), strict=True))


def test_cut_is_that_of_a_sort(spark):
    pick = np.random.default_rng(4)
    keys = np.concatenate([pick.normal(size=300), pick.normal(size=200) * 1e6, np.full(40, 0.25)])
    rows = [(float(k), i * 7919 % 1000) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key double, mixed long").cache()
    for k in (1, 2, 100, 270, 300, 539, 540):
        key, mixed = r.cut(df, k)
        chosen = [x for x in rows if x[0] > key or x[0] == key and (mixed is None or x[1] <= mixed)]
        best = sorted(rows, key=lambda x: (-x[0], x[1]))[:k]
        assert best == sorted(chosen, key=lambda x: (-x[0], x[1]))[:k]
        assert len(chosen) == k or mixed is None


def test_hard_documents(spark):
    docs = hard.documents(spark)
    targets = docs.where("doc_id % 2 = 0").select("doc_id")
    rows = r.resample(docs, targets, 0.5)
    assert rows.count() == docs.count() and rows.where("isnan(gumbel_key) OR gumbel_key IS NULL").count() == 0
    assert hard.rows_of(rows) == hard.rows_of(r.resample(docs, targets, 0.5))
    assert hard.rows_of(rows) != hard.rows_of(r.resample(docs, targets, 0.5, seed=6))
    assert r.resample(docs, targets, 0.0).where("selected").count() == 0
    assert r.resample(docs, targets, 1.0).where("NOT selected").count() == 0
    assert r.resample(hard.none(spark), targets).count() == 0
    assert r.resample(docs, targets.limit(0)).count() == docs.count()


def test_query(spark):
    rows = entry.queries()["op1_importance_resampling"](spark, FOLDER).toPandas()
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert len(rows) == n and rows.selected.sum() == math.ceil(r.SHARE * n)
    assert rows[rows.selected].gumbel_key.min() > rows[~rows.selected].gumbel_key.max()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    chosen = rows.merge(labels, on="doc_id").groupby("quality").selected.mean()
    assert chosen[1] > chosen[0] + 0.3

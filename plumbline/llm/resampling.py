"""Importance resampling: texts are drawn in proportion to how much likelier they are under a target than under the raw corpus.

Both are generative models of n-grams: words and word pairs hash into a fixed number of buckets, and a model is the
share of each bucket among all n-grams of its texts.  A text's weight is the product, over its n-grams, of target
over raw shares.  Adding Gumbel noise to the logs of the weights and taking the ``k`` largest draws ``k`` texts without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Numbers, arrow, column, portions, sums, texts_of
from plumbline.session import scratch_folder

BUCKETS = 10_000
SHARE = 0.8
WORDS_KEPT = 500_000
#: ASCII letters in lower case, digits and bytes of other characters make words, and every other sign is one.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PAIR = np.uint64(0x9E3779B97F4A7C15)
COUNTED = {"target": pa.bool_(), "bucket": pa.int64(), "n": pa.int64()}
WEIGHED = {"doc_id": pa.int64(), "mixed": pa.int64(), "log_weight": pa.float64()}


class Hasher:
    """Buckets of the words and word pairs of texts."""

    def __init__(self) -> None:
        self.numbers, self.hashes = Numbers(), np.zeros(0, dtype=np.uint64)

    def buckets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of each text, and the bounds of the texts: first the words, then the pairs."""
        if len(self.numbers) > WORDS_KEPT:
            self.numbers.forget()
            self.hashes = self.hashes[:0]
        ids, bounds = self.numbers.of([(x or "").encode().translate(SIGNS).split() for x in texts])
        if self.numbers.fresh:
            fresh = [xxhash.xxh64_intdigest(w) for w in self.numbers.fresh]
            self.hashes = np.concatenate([self.hashes, np.array(fresh, dtype=np.uint64)])
            self.numbers.fresh.clear()
        words = self.hashes[ids]
        grams = np.zeros(2 * len(words), dtype=np.int64)
        grams[0::2] = words % np.uint64(BUCKETS)
        # The last word of a text begins no pair; its place holds a bucket of no weight.
        grams[1::2] = BUCKETS
        pairs = (words[:-1] * PAIR + words[1:]) >> np.uint64(20)
        grams[1:-2:2] = pairs % np.uint64(BUCKETS)
        ends = bounds[1:][bounds[1:] > bounds[:-1]]
        grams[2 * ends - 1] = BUCKETS
        return grams, 2 * bounds


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, total = Hasher(), np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for part, texts in portions(batches):
        target = part.column(0).fill_null(False).to_numpy(zero_copy_only=False)
        grams, bounds = hasher.buckets(texts)
        total[0] += np.bincount(grams, minlength=BUCKETS + 1)
        wanted = np.repeat(target, np.diff(bounds))
        total[1] += np.bincount(grams[wanted], minlength=BUCKETS + 1)
    model, bucket = np.nonzero(total[:, :BUCKETS])
    yield arrow({"target": model == 1, "bucket": bucket, "n": total[model, bucket]}, COUNTED)


def log_ratios(docs: DataFrame, targets: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """For each bucket the log of its share in the target over its share in all of ``docs``.

    ``targets (doc_id)`` names the rows that make the target.  All texts are counted; each task sends two
    numbers for each bucket.
    """
    chosen = targets.select(column("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    rows = texts_of(docs).join(chosen.hint("shuffle_hash"), "doc_id", "left").select("target", "text")
    found = rows.mapInArrow(counted, "target boolean, bucket long, n long")
    got = found.groupBy("target", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((2, BUCKETS), smoothing)
    total[got["target"].to_numpy(dtype=int), got["bucket"].to_numpy(dtype=int)] += got["n"].to_numpy(dtype=float)
    shares = total / total.sum(axis=1, keepdims=True)
    return np.append(np.log(shares[1] / shares[0]), 0.0)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``(doc_id, mixed, log_weight)``; ``mixed`` is a hash of the row's ``doc_id`` and text."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, texts in portions(batches):
            grams, bounds = hasher.buckets(texts)
            weight = sums(ratios[grams], bounds)
            yield arrow({"doc_id": part.column(0), "mixed": part.column(1), "log_weight": weight}, WEIGHED)

    rows = texts_of(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("mixed"), "text")
    return rows.mapInArrow(weigh, "doc_id long, mixed long, log_weight double")


def gumbel(mixed: Column, seed: int) -> Column:
    """Noise that follows from the row and the seed alone, so that a repeated task draws the same."""
    half = F.shiftrightunsigned(F.xxhash64(mixed, F.lit(seed)), 11).cast("double")
    return -F.log(-F.log((half + 0.5) / float(1 << 53)))


def cut(rows: DataFrame, k: int) -> tuple[float, int | None]:
    """The key and the hash of the ``k``-th row by falling ``key``, then rising ``mixed``.

    The stretch of keys that holds it is cut into 4096, again and again, by counts alone, until few
    rows or a single key are left; those are sorted.
    """
    low, high, before = *rows.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
        step = (high - low) / 4096
        if step <= 0 or low + step == low:
            break
        bin_ = F.least(F.floor((F.lit(high) - F.col("key")) / step), F.lit(4095)).cast("int").alias("bin")
        counts = inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in counts.orderBy("bin").collect():
            if before + row["n"] >= k:
                low, high, size = row["low"], row["high"], row["n"]
                break
            before += row["n"]
        if size <= 10_000 or low == high:
            inside = rows.where((F.col("key") >= low) & (F.col("key") <= high))
            break
    if low == high:
        # Equal keys are repeated rows, which stay together.
        return low, None
    last = inside.orderBy(F.desc("key"), "mixed").limit(k - before).agg(F.min(F.struct("key", (-F.col("mixed")).alias("m")))).first()[0]
    return last["key"], -last["m"]


def resample(docs: DataFrame, targets: DataFrame, share: float = SHARE, seed: int = 5) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, selected)`` for every row.

    ``selected`` marks the ``ceil(share * rows)`` rows with the largest keys; rows that repeat both ``doc_id``
    and text are drawn together.  NULL and empty texts have weight 1.  Without targets the target's model
    is even.  A table without rows gives none.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "weights")
    weights = log_weights(docs, log_ratios(docs, targets))
    weights.withColumn("key", F.col("log_weight") + gumbel(F.col("mixed"), seed)).write.parquet(folder)
    rows = spark.read.schema("doc_id long, mixed long, log_weight double, key double").parquet(folder)
    total = rows.count()
    k = int(np.ceil(share * total))
    selected = F.lit(False)
    if k:
        key, mixed = cut(rows, k)
        selected = F.col("key") >= key
        if mixed is not None:
            selected = (F.col("key") > key) | ((F.col("key") == key) & (F.col("mixed") <= mixed))
    return rows.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), selected.alias("selected"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels.where(column("quality") == 1))

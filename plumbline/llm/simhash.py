"""Near copies by SimHash fingerprints and a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.words import arrow, column, portions, texts_of
from plumbline.session import scratch_folder

BITS = 64
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
LANES = np.uint64(0x0101010101010101)
TILE = 1024
FINGERPRINT = {"doc_id": pa.int64(), "body": pa.int64(), "fp": pa.int64()}
PRINTED = "doc_id long, body long, fp long"
LINK = {"a": pa.int64(), "b": pa.int64()}


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of ``hashes``."""
    counts = np.zeros((8, 8), dtype=np.int64)
    for start in range(0, len(hashes), 255 * 256):
        block = hashes[start : start + 255 * 256]
        block = np.concatenate([block, np.zeros(-len(block) % 255, dtype=np.uint64)])
        lanes = (block[:, None] >> np.arange(8, dtype=np.uint64)) & LANES
        # 255 lanes of one bit each fit into a byte.
        counts += lanes.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    bits = (counts.T.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def hashed(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles; those of a text with fewer words are that of the whole, or none."""
    words = (text or "").encode().translate(LOWER).split()
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(whole, seed)] if words else [], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = [digest(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    hashes = hashed(text, shingle, seed)
    return int(hashes[0]) if len(hashes) == 1 else majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, body, fp)`` for every row; a NULL text is an empty one, whose fingerprint is zero.

    ``body`` is a hash of the text, which tells differing texts of one ``doc_id`` apart.
    """

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches):
            found = np.array([fingerprint(x, shingle, seed) for x in texts], dtype=np.uint64)
            yield arrow({"doc_id": part.column(0), "body": part.column(1), "fp": found.view(np.int64)}, FINGERPRINT)

    rows = texts_of(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(prints, PRINTED)


def masks(blocks: int, same: int) -> list[int]:
    """Bit masks of every choice of ``same`` among ``blocks`` stretches of the fingerprint."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    stretches = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(stretches, same)]


def signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def pivots(number: int) -> np.ndarray:
    """Reference fingerprints, spread at random but always the same."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(number)], dtype=np.uint64)


def close_pairs(
    fps: np.ndarray, groups: np.ndarray, table: np.ndarray, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs at ``most`` or fewer bits, within stretches of equal ``groups``.

    ``table`` has a row of distances to the pivots for each fingerprint.  A pair whose distances to
    some pivot differ by more than ``most`` cannot be closer than that.
    """
    left = np.arange(len(fps) - 1)
    step = 1
    while len(left):
        left = left[left + step < len(fps)]
        left = left[groups[left] == groups[left + step]]
        kept = left
        for some in range(0, table.shape[1], 4):
            apart = np.abs(table[kept, some : some + 4] - table[kept + step, some : some + 4]).max(axis=1, initial=0)
            kept = kept[apart <= most]
        kept = kept[np.bitwise_count(fps[kept] ^ fps[kept + step]) <= most]
        if len(kept):
            yield kept, kept + step
        step += 1


def joined(fps: np.ndarray, groups: np.ndarray, references: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fingerprint with close ones in its stretch, one link towards the first of them all."""
    table = np.bitwise_count(fps[:, None] ^ references).astype(np.int8)
    root = np.arange(len(fps))

    def fold(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            if (open_ := low < high).sum() == 0:
                break
            np.minimum.at(root, high[open_], low[open_])
            while not np.array_equal(root, root[root]):
                root[:] = root[root]

    waiting, size = [], 0
    for pair in close_pairs(fps, groups, table, most):
        waiting.append(pair)
        size += len(pair[0])
        if size > 500_000:
            fold(waiting)
            waiting, size = [], 0
    if waiting:
        fold(waiting)
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, most: int = 3, blocks: int = 6, references: int = 16) -> DataFrame:
    """Links ``(a, b)`` that join the same fingerprints as all pairs at ``most`` or fewer bits do.

    Comparing pivot distances of all pairs would take a cross join, so fingerprints meet only where
    they can be close: of ``blocks`` stretches of bits at least ``blocks - most`` are equal in a close
    pair, and a fingerprint goes to a meeting for each choice of that many.  At a meeting pairs are
    discarded by the largest difference of their distances to the pivots, and the rest are
    verified.  A meeting of more than ``TILE`` fingerprints is held in tiles, each pair of tiles
    in another task perhaps; every meeting sends out fewer links than it has fingerprints.
    """
    chosen = masks(blocks, blocks - most)
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(chosen)))
    met = distinct.select("fp", F.explode(keys).alias("at")).select("fp", "at.choice", "at.key")
    sizes = met.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = met.join(sizes, ["choice", "key"])
    tiles = F.ceil(F.col("size") / TILE)
    met = met.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), "tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = met.withColumn("other", other).select(
        F.xxhash64("choice", "key", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), "fp"
    )
    bits = pivots(references)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_groups, kept_fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def found(groups: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = joined(fps.view(np.uint64), groups, bits, most)
            return arrow({"a": a.view(np.int64), "b": b.view(np.int64)}, LINK)

        for batch in batches:
            groups = np.concatenate([kept_groups, batch.column(0).to_numpy()])
            fps = np.concatenate([kept_fps, batch.column(1).to_numpy()])
            # The last meeting may go on in the next batch.
            whole = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            kept_groups, kept_fps = groups[whole:], fps[whole:]
            if whole:
                yield found(groups[:whole], fps[:whole])
        if len(kept_fps):
            yield found(kept_groups, kept_fps)

    # Meetings whose hashes are equal merge, which costs comparisons and changes no link.
    dealt = met.repartition("meeting").sortWithinPartitions("meeting")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def grouped(docs: DataFrame, most: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, stored in ``folder``; and each distinct one with the root of its group."""
    fingerprints(docs).write.parquet(folder)
    rows = docs.sparkSession.read.schema(PRINTED).parquet(folder)
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), most))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return rows, placed.withColumn("root", F.coalesce("root", "fp"))


def near_copies(docs: DataFrame, most: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Rows are near copies if a chain of fingerprints, each ``most`` or fewer bits from the next, leads
    from one to the other; ``component_id`` is the smallest ``doc_id`` so reached.  Rows with a NULL
    ``doc_id`` take part, and are the smallest only where no other is there (NULL then).  A table
    without rows gives none.
    """
    rows, placed = grouped(docs, most, scratch_folder(docs.sparkSession, "fingerprints"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.select("fp", "root"), "fp").join(smallest, "root").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_copies(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, most: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near copies is kept.

    That is the one with the smallest ``doc_id`` (a NULL comes last), of several texts under that id the one with
    the smallest hash, with all columns as they were; of rows that repeat both id and text one stays.  It goes by rows,
    not by ids: another text under the same id stays if its own group has no smaller.
    """
    rows, placed = grouped(docs, most, scratch_folder(docs.sparkSession, "fingerprints"))
    counted = rows.groupBy("doc_id", "body", "fp").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body", "times")).alias("first")
    kept = counted.join(placed.select("fp", "root"), "fp").groupBy("root").agg(first)
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.body").alias("kept_body"), "first.times")
    texts = column("text").cast("string")
    all_rows = docs.select(F.struct("*").alias("row"), column("doc_id").cast("long").alias("id"), F.xxhash64(texts).alias("body"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("body") == F.col("kept_body"))
    # Texts are shuffled once, and only those of repeated rows are compared further.
    staying = all_rows.join(kept.hint("shuffle_hash"), same)
    repeated = staying.where("times > 1").dropDuplicates(["id", "body"])
    return staying.where("times = 1").union(repeated).select("row.*")

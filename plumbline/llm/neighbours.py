"""Nearest neighbours by inner product, found by collision counting over single projections.

Vectors get one more coordinate that makes them all equally long, after which the largest inner product with
a query is the smallest distance to it.  Every projection on a random line has a sorted array of its own.  A
query opens a window about its own value in each of them; virtual rehashing widens all windows by a factor,
again and again, and a vector that lies in enough of them is verified by its exact inner product.  The windows
stop when a given share of the vectors, and as many as are asked for, have been verified.  Equal vectors are one there, so that many copies of
one do not use up the share; ranking puts all their rows back.

The vectors are cut into shards and the queries into blocks, and each shard meets each block in a task; how many
there are grows with the tables, their sizes do not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.words import column, importable

FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}


@dataclass(frozen=True)
class Settings:
    """``projections`` lines; a vector in ``collisions`` of the windows is verified, up to ``verified`` of a shard's distinct ones."""

    projections: int = 64
    collisions: float = 0.8
    verified: float = 0.3
    widening: float = 1.08
    shard: int = 4096
    block: int = 4096
    seed: int = 11


class Index:
    """The sorted arrays of a shard's distinct vectors; ``copy_of`` has for each row the one it equals."""

    def __init__(self, vectors: np.ndarray, length: float, settings: Settings) -> None:
        rows = np.ascontiguousarray(vectors + 0.0)  # No negative zeros: equal rows have equal bytes.
        _, first, self.copy_of = np.unique(
            rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True
        )
        vectors = rows[first]
        self.vectors, self.length, self.settings = vectors, length, settings
        lines = np.random.default_rng(settings.seed).normal(size=(vectors.shape[1] + 1, settings.projections))
        self.lines = lines
        lift = np.sqrt(np.maximum(0, length**2 - (vectors**2).sum(axis=1)))
        values = vectors @ lines[:-1] + lift[:, None] * lines[-1]
        self.sorted = np.asfortranarray(np.sort(values, axis=0))
        self.rank = np.argsort(np.argsort(values, axis=0, kind="stable"), axis=0).T.astype(np.uint32)
        if len(vectors) < 1 << 16:
            self.rank = self.rank.astype(np.uint16)
        self.rank = np.ascontiguousarray(self.rank)

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """For each query which distinct vectors are verified: ``k`` or more that are not its ``own``, or all."""
        n, m = self.rank.shape[1], self.settings.projections
        needed, enough = int(np.ceil(self.settings.collisions * m)), int(np.ceil(self.settings.verified * n))
        long = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        values = queries * (self.length / long) @ self.lines[:-1]
        chosen = np.zeros((len(queries), n), dtype=bool)
        width = self.first_width(values)
        active = np.arange(len(queries))
        while len(active):
            low, high = self.windows(values[active], width[active])
            count = np.zeros((len(active), n), dtype=np.uint8 if m < 256 else np.uint16)
            place = np.empty((len(active), n), dtype=self.rank.dtype)
            inside = np.empty((len(active), n), dtype=bool)
            for j in range(m):
                # An unsigned difference is below the window's size on its inside alone.
                np.subtract(self.rank[j], low[:, j, None], out=place)
                np.less(place, (high - low)[:, j, None], out=inside)
                np.add(count, inside, out=count, casting="unsafe")
            chosen[active] = count >= needed
            verified, others = chosen[active].sum(axis=1), (chosen[active] & ~own[active]).sum(axis=1)
            done = (verified >= enough) & (others >= k) | ((high - low).min(axis=1) >= n)
            active = active[~done]
            width[active] *= self.settings.widening
        return chosen

    def windows(self, values: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.empty(values.shape, dtype=self.rank.dtype) for _ in range(2))
        for j in range(values.shape[1]):
            low[:, j] = np.searchsorted(self.sorted[:, j], values[:, j] - width, "left")
            high[:, j] = np.searchsorted(self.sorted[:, j], values[:, j] + width, "right")
        return low, high

    def first_width(self, values: np.ndarray) -> np.ndarray:
        """The widths to begin with: windows that hold somewhat less than is needed, on the average of some lines."""
        wanted = max(0.0, self.settings.collisions - 0.12) * len(self.vectors)
        some = range(0, values.shape[1], max(1, values.shape[1] // 16))
        low, high = np.zeros(len(values)), np.full(len(values), float(np.ptp(self.sorted) + np.ptp(values) + 1e-3))
        for _ in range(12):
            middle = (low + high) / 2
            held = np.zeros(len(values))
            for j in some:
                line = self.sorted[:, j]
                held += np.searchsorted(line, values[:, j] + middle) - np.searchsorted(line, values[:, j] - middle)
            few = held < wanted * len(some)
            low, high = np.where(few, middle, low), np.where(few, high, middle)
        return np.maximum(low, 1e-3 * self.length)

    def only(self, rows: np.ndarray) -> np.ndarray:
        """Which distinct vectors stand in these rows alone."""
        n = len(self.vectors)
        return np.bincount(self.copy_of[~rows], minlength=n) == 0

    def nearest(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> dict[str, np.ndarray]:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(queries), 32):
            part = queries[start : start + 32]
            mine = np.stack([self.only(ids == own) for own in query_ids[start : start + 32]])
            for i, chosen in enumerate(self.candidates(part, mine, k)):
                own = query_ids[start + i]
                here = np.nonzero(chosen[self.copy_of] & (ids != own))[0]
                # Row by row, so that equal vectors have equal scores wherever they stand.
                exact = np.zeros(len(chosen))
                exact[chosen] = np.einsum("ij,j->i", self.vectors[chosen], part[i])
                score = exact[self.copy_of[here]]
                best = np.lexsort([ids[here], -score])[:k]
                rows.append((np.full(len(best), own), ids[here[best]], score[best]))
        query, found, score = (np.concatenate(x) for x in zip(*rows, strict=True))
        return {"query_id": query, "vec_id": found, "score": score}


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, vec, length)`` of the vectors that take part."""
    rows = vectors.select(
        column(id_column).cast("long").alias("vec_id"), column(vector_column).cast("array<double>").alias("vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    return rows.where(F.col("vec_id").isNotNull() & finite).withColumn("length", length).where("length > 0")


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest found, all if there are fewer.

    Queries are the rows whose id is divisible by ``every``, one for each id; candidates are all rows of
    other ids.  Score is the inner product in double precision; ties go to smaller ids, and rows that
    repeat an id count as often.  Vectors that are NULL, zero, of another length than most, or hold NULL
    or what is not finite take no part, nor do rows without an id.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(
        F.count("*").alias("n"), F.max("length").alias("length"), F.count_if(F.col("vec_id") % every == 0).alias("queries")
    )
    usual = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rows = rows.where(F.size("vec") == usual["size"]).select("vec_id", "vec")
    shards, blocks = -(-usual["n"] // settings.shard), max(1, -(-usual["queries"] // settings.block))
    here = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int")
    data = rows.select(
        here.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"), "*"
    )
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    queries = asking.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(1).alias("asks"),
        "*",
    )
    length = float(usual["length"])

    def meet(tile: pa.Table) -> pa.Table:
        asks = tile.column("asks").to_numpy() == 1
        ids = tile.column("vec_id").to_numpy()
        flat = tile.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        all_vectors = flat.reshape(len(ids), -1)
        if asks.all() or not asks.any():
            return pa.Table.from_pydict({n: pa.array([], type=t) for n, t in FOUND.items()})
        index = Index(all_vectors[~asks], length, settings)
        found = index.nearest(ids[~asks], ids[asks], all_vectors[asks], k)
        return pa.Table.from_pydict({n: pa.array(found[n], type=t) for n, t in FOUND.items()})

    found = data.union(queries).groupBy("shard", "block").applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

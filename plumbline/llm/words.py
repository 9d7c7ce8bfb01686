"""Texts as arrays of word numbers, inside tasks."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHARACTERS_AT_ONCE = 1_000_000


def column(name: str) -> Column:
    """A column by its very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the driver found it.

    Workers on other machines get it as any application's modules, by ``--py-files`` say.
    """
    place = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if place not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([place, *filter(None, paths)])


def texts_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, so that other columns of any name do no harm."""
    importable(df.sparkSession)
    return df.select(
        column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").alias("text")
    )


def portions(
    batches: Iterable[pa.RecordBatch], characters: int = CHARACTERS_AT_ONCE
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows whose last column is a text, a few at a time.

    Their texts come to ``characters`` or little more, but a longer text is still whole.
    """
    for part in sized(batches, characters):
        yield part, part.column(part.num_columns - 1).to_pylist()


def sized(batches: Iterable[pa.RecordBatch], characters: int) -> Iterator[pa.RecordBatch]:
    """The same rows, not yet lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.num_columns - 1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + characters, "right")))
            yield batch.slice(start, end - start)
            start = end


class Numbers(dict):
    """Consecutive numbers for words in the order in which they are first asked for.

    ``fresh`` holds the words numbered since it was last emptied.  The numbers hold until
    :meth:`forget`, which the owner calls when there are too many: what is kept about words only
    saves time.
    """

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def forget(self) -> None:
        self.clear()
        self.fresh.clear()

    def of(self, lists: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of all lists, and where each list begins and ends."""
        bounds = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in lists], out=bounds[1:])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=bounds[-1])
        return numbers, bounds


class Ragged:
    """Rows of different lengths in one array, which grows by whole blocks of rows."""

    def __init__(self, dtype) -> None:
        self.flat, self.bounds = np.zeros(0, dtype=dtype), np.zeros(1, dtype=np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows one after the other, and their lengths."""
        starts = self.bounds[rows]
        lengths = self.bounds[rows + 1] - starts
        return self.flat[spread(starts, lengths)], lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, as many as its length says."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each stretch between two bounds; 0 for an empty one."""
    running = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0)])
    return running[bounds[1:]] - running[bounds[:-1]]


def arrow(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch with the columns that ``types`` names, in that order."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], type=kind) for name, kind in types.items()], names=list(types)
    )

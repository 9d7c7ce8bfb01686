"""Metrics of any range of days, or other numbered parts, from few stored states.

The numbers are the leaves of a binary tree: node ``level/i`` holds the merged state of the numbers from ``i 2^level`` up to
the next node of its level.  A range is made of two nodes a level at most, whatever its length, where a list of
parts would be read whole.  Saving numbers anew rewrites the nodes above them, from the new states and from the nodes beside
their paths; other states are not read.

The tree ends at a highest level.  Longer ranges take several nodes of it, and every state is stored once a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.metrics import Metric
from plumbline.streaming.states import StateStore, live_states

LEVELS = 10


class Overtaken(Exception):
    """Another writer has committed since the states were read."""


def node(level: int, index: int) -> str:
    return f"{level}/{index}"


def cover(first: int, last: int, levels: int) -> list[str]:
    """The largest nodes that make up the numbers from ``first`` to ``last``, in their order."""
    nodes = []
    while first <= last:
        level = levels
        while first % (1 << level) or first + (1 << level) - 1 > last:
            level -= 1
        nodes.append(node(level, first >> level))
        first += 1 << level
    return nodes


def _of_node(part: str = "part") -> tuple[Column, Column]:
    """Level and index of a node by its name."""
    at = F.split(part, "/")
    return at[0].cast("int"), at[1].cast("long")


class RangeStates:
    """Mergeable states under one folder, of parts that are whole numbers: days, hours, loads, below zero as well."""

    def __init__(self, spark: SparkSession, path: str, levels: int = LEVELS):
        self._store, self._levels = StateStore(spark, path), levels
        self._ledger = self._store._ledger

    def version(self) -> int:
        """The number of the last commit, to read at later on."""
        return self._ledger.version()

    def save(self, df: DataFrame, metrics: Sequence[Metric], number: int | Column) -> int:
        """Store states of ``df`` and return the version; ``number`` is that of all rows, or a column.

        A number saved again replaces its state.  Rows whose number is NULL are in no range, and left out.
        The new states and all nodes above them become visible together.  Should another writer commit meanwhile, the
        nodes are merged again from what is there then; the data is not read twice.
        """
        if isinstance(number, int):
            leaves = self._store._write_states(df, metrics, node(0, number))
        else:
            numbered = df.where(number.isNotNull())
            leaves = self._store._write_states(numbered, metrics, F.concat(F.lit("0/"), number.cast("long").cast("string")))
        new = self._store._entries(leaves, "save")
        while True:
            base = self.version()
            merged = self._store._write_merged(self._beside(new, base).unionByName(new.select("id", "part", "batch")), self._above)
            entries = new.unionByName(self._store._entries(merged, "save"))
            try:
                return self._ledger.commit(entries, lambda last: self._unless_overtaken(last, base))
            except Overtaken:
                continue

    def metrics(self, like: DataFrame, metrics: Sequence[Metric], first: int, last: int, at: int | None = None) -> DataFrame:
        """Metrics over the numbers from ``first`` to ``last``, both included; numbers never saved are empty.

        A ``ValueError`` names the metrics that some number in the range has no state of but has one of others, or says that
        there is none in it.
        """
        self._store._check(like, metrics)
        log = self._ledger.read(at)
        level, index = _of_node()
        self._store._check_held(like, metrics, log, (level == 0) & index.between(first, last))
        return self._store._values(like, metrics, self.states(first, last, at))

    def states(self, first: int, last: int, at: int | None = None) -> DataFrame:
        """``(id, part, batch)`` of the states that a range is read from."""
        return live_states(self._ledger.read(at), cover(first, last, self._levels))

    def _unless_overtaken(self, last: int, base: int) -> None:
        if last != base:
            raise Overtaken

    def _above(self, states: DataFrame) -> DataFrame:
        """Each state once for every node above its own."""
        level, index = _of_node()
        placed = states.withColumns({"own level": level, "own index": index}).where(F.col("own level") < self._levels)
        up = F.explode(F.expr(f"sequence(`own level` + 1, {self._levels})"))
        name = F.expr("concat(up, '/', shiftright(`own index`, up - `own level`))")
        return placed.withColumn("up", up).withColumn("part", name).drop("up", "own level", "own index")

    def _beside(self, new: DataFrame, base: int) -> DataFrame:
        """The stored nodes next to the paths of new leaves: with those they make up every node above, once each."""
        paths = self._above(new.select("id", "part")).distinct()
        level, index = _of_node()
        below = F.explode(F.array(*[F.concat_ws("/", level - 1, 2 * index + side) for side in (0, 1)]))
        children = paths.select("id", below.alias("part"))
        beside = children.join(paths.unionByName(new.select("id", "part")), ["id", "part"], "left_anti")
        return live_states(self._ledger.read(base), rolled=False).join(beside, ["id", "part"], "left_semi")

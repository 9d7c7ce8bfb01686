"""Exact quantiles of stored parts: sorted runs of values with their counts, and the slots that they are cut into.

Each part keeps the distinct values of a column in order, in slots of a fixed number of values.  Beside them stand the
heads, a row per slot with its least and greatest value and its rows.  Heads alone bound the value at a rank from both
sides: at a value ``x`` at most the slots that begin by then count, and at least those that end by then.  Only the slots
that reach into these bounds are read, two or three of a part, and the rest counts by its heads.

The hunt for a rank is by passes of plain aggregation, as over a table: evenly spaced pivots of the values still
in question, then the rows at and between them, so that nothing is sorted and only pivots and sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import Scope
from plumbline.operators.quantiles import ACCURACY, ChangingSource

RUN_SCHEMA = "value double, count bigint, slot bigint, run_id string, part string"
HEAD_SCHEMA = "slot bigint, low double, high double, rows bigint, run_id string, part string"
SLOT_VALUES = 4096
PIVOTS = 64


def run_counts(df: DataFrame, column: str, where: str | None, run_id: str, part: Column) -> DataFrame:
    """How often each value of a part occurs; NULL is no value."""
    value = Scope(df.schema, where).column(column).cast("double").alias("value")
    rows = df if where is None else df.filter(F.expr(where))
    counts = rows.select(value, part.alias("part")).where("value IS NOT NULL").groupBy("part", "value").count()
    return counts.withColumn("run_id", F.lit(run_id))


def in_slots(counts: DataFrame, values: int) -> DataFrame:
    """The counts in order, cut into slots; a slot is a stretch of one task's rows, so that no window is needed."""
    ordered = counts.orderBy("run_id", "part", "value")
    return ordered.withColumn("slot", F.expr(f"monotonically_increasing_id() div {values}"))


def heads_of(runs: DataFrame, there: DataFrame) -> DataFrame:
    """A row for each slot, and for each ``(run_id, part)`` there is a row without values, which says so."""
    heads = runs.groupBy("run_id", "part", "slot").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("count").alias("rows")
    )
    none = F.lit(None).cast("double")
    empty = there.select("run_id", "part", F.lit(-1).alias("slot"), none.alias("low"), none.alias("high"), F.lit(0).alias("rows"))
    return heads.unionByName(empty)


@dataclass
class _Hunt:
    """The search for the least value by which the weights sum up to a rank, among the rows that ``mine`` holds for."""

    name: Hashable  # of those rows
    mine: Column
    values: Column
    weight: Column
    rank: int
    low: float | None = None  # exclusive bounds of the values still in question
    high: float | None = None
    passed: int = 0  # the weights up to ``low``
    pivots: list[float] = field(default_factory=list)
    answer: float | None = None

    @property
    def question(self) -> Hashable:
        return (self.name, self.low, self.high)

    def is_open(self) -> Column:
        inside = self.mine
        if self.low is not None:
            inside &= self.values > F.lit(self.low)
        if self.high is not None:
            inside &= self.values < F.lit(self.high)
        return inside

    def proposal(self) -> Column:
        shares = [i / (PIVOTS - 1) for i in range(PIVOTS)]
        return F.percentile_approx(F.when(self.is_open(), self.values), shares, ACCURACY)

    def cell(self) -> Column:
        """Twice the pivots below a value, and one more if it is the next pivot."""
        pivots = F.lit(self.pivots)
        return 2 * F.size(F.filter(pivots, lambda p: p < self.values)) + F.array_contains(pivots, self.values).cast("int")

    def narrow(self, sums: Mapping[int, int]) -> None:
        """Go on in the cell that the rank falls into; that of a pivot is the answer."""
        for cell in sorted(sums):
            if self.passed + sums[cell] < self.rank:
                self.passed += sums[cell]
                continue
            at = cell // 2
            if cell % 2:
                self.answer = self.pivots[at]
            self.low = self.pivots[at - 1] if at else self.low
            self.high = self.pivots[at] if at < len(self.pivots) else self.high
            return
        raise ChangingSource("the states changed between two passes over them")


def _hunt(rows: DataFrame, hunts: Mapping[Hashable, _Hunt]) -> dict[Hashable, float]:
    """All hunts over the same rows, by shared passes; those with the same open values share their pivots."""
    while running := [hunt for hunt in hunts.values() if hunt.answer is None]:
        asked = {hunt.question: hunt for hunt in running}
        pivots = dict(zip(asked, rows.agg(*_named(hunt.proposal() for hunt in asked.values())).first()))
        for hunt in running:
            if not pivots[hunt.question]:
                raise ChangingSource("the states changed between two passes over them")
            hunt.pivots = list(dict.fromkeys(pivots[hunt.question]))
        cells = [
            F.when(hunt.is_open(), F.struct(F.lit(i).alias("hunt"), hunt.cell().alias("cell"), hunt.weight.alias("weight")))
            for i, hunt in enumerate(running)
        ]
        found = rows.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("hunt", "cell").agg(F.sum("weight"))
        sums: dict[int, dict[int, int]] = {}
        for i, cell, weight in found.collect():
            sums.setdefault(i, {})[cell] = weight
        for i, hunt in enumerate(running):
            hunt.narrow(sums.get(i, {}))
    return {key: hunt.answer for key, hunt in hunts.items()}


def _named(columns: Iterable[Column]) -> list[Column]:
    return [column.alias(f"c{i}") for i, column in enumerate(columns)]


def bounds_of(heads: DataFrame, wanted: Iterable[tuple[str, float]]) -> dict[tuple[str, float], tuple[int, float, float]]:
    """For each ``(run_id, quantile)`` with values its rank, and two values that the one at the rank lies between."""
    totals = dict(tuple(row) for row in heads.groupBy("run_id").agg(F.sum("rows")).collect())
    ranks = {
        (run, q): max(1, math.ceil(Fraction(str(q)) * totals[run])) for run, q in wanted if totals.get(run)
    }
    slots = heads.where("rows > 0")
    hunts = {
        (key, end): _Hunt((key[0], end), F.col("run_id") == key[0], F.col(end), F.col("rows"), rank)
        for key, rank in ranks.items()
        for end in ("low", "high")
    }
    found = _hunt(slots, hunts) if hunts else {}
    return {key: (rank, found[key, "low"], found[key, "high"]) for key, rank in ranks.items()}


def reaching(run: str, low: float, high: float) -> Column:
    """The slots of a run that hold values between two, by their heads."""
    return (F.col("run_id") == run) & (F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high))


def quantile_values(
    heads: DataFrame, runs: DataFrame, wanted: Iterable[tuple[str, float]]
) -> dict[tuple[str, float], float]:
    """The value at rank ``ceil(q n)`` for each ``(run_id, quantile)``; what has no values is left out.

    Both frames have a column ``batch``, which together with part and slot names a slot of a run.
    """
    heads = heads.persist()
    try:
        return _values_by(heads, runs, bounds_of(heads, wanted))
    finally:
        heads.unpersist()


def _values_by(
    heads: DataFrame, runs: DataFrame, bounds: Mapping[tuple[str, float], tuple[int, float, float]]
) -> dict[tuple[str, float], float]:
    values = {key: low for key, (_, low, high) in bounds.items() if low == high}
    unsure = {key: bound for key, bound in bounds.items() if key not in values}
    if not unsure:
        return values
    slots = heads.where("rows > 0")
    before = [
        F.sum(F.when((F.col("run_id") == run) & (F.col("high") < F.lit(low)), F.col("rows")).otherwise(0))
        for (run, _), (_, low, _) in unsure.items()
    ]
    needed = slots.where(reduce(or_, [reaching(run, low, high) for (run, _), (_, low, high) in unsure.items()]))
    passed = slots.agg(*_named(before)).first()
    least, greatest = needed.agg(F.min("low"), F.max("high")).first()
    within = runs.where((F.col("value") >= F.lit(least)) & (F.col("value") <= F.lit(greatest)))
    kept = _of_slots(within, needed).persist()
    try:
        hunts = {
            (run, q): _Hunt((run, low, high), reaching(run, low, high), F.col("value"), F.col("count"), rank - count)
            for ((run, q), (rank, low, high)), count in zip(unsure.items(), passed)
        }
        return values | _hunt(kept, hunts)
    finally:
        kept.unpersist()


def _of_slots(runs: DataFrame, slots: DataFrame) -> DataFrame:
    """The rows of some slots, each with the ends of its slot."""
    names = {name: f"of_{name}" for name in ("run_id", "part", "batch", "slot")}
    ends = slots.select(*[F.col(name).alias(new) for name, new in names.items()], "low", "high")
    same = [F.col(name).eqNullSafe(F.col(new)) for name, new in names.items()]
    return runs.join(ends, same).select("run_id", "value", "count", "low", "high")

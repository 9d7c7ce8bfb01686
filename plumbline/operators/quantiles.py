"""Exact quantiles by selection: no sort, no shuffle of the data, no map of its values.

``percentile_disc`` keeps every distinct value in one task.  Here each pass is a plain
aggregation over one pruned column.  A pass proposes pivots near the wanted ranks, by a
bounded sketch of the values still in question; the next counts the rows below and at each
pivot.  A pivot whose rows cover the wanted rank is the answer; any other one narrows the
range.  With sketches of accuracy A a pair of passes shrinks a range by a factor near A, and in a
range of fewer than A rows the sketch names the value itself, so 10^12 rows take some four pairs.
All quantiles of all columns share the passes, and only pivots and counts reach the driver.

A source that changes between the passes may leave no value at the wanted rank.  A search that gets no
nearer says so instead of going on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators.metrics import Scope

ACCURACY = 10_000
MARGIN = 2 / ACCURACY


class ChangingSource(Exception):
    """The passes over a source contradict each other."""


@dataclass
class _Search:
    """The hunt for the value at one rank among the non-null values of a column."""

    values: Column
    quantile: float
    rank: int | None = None
    low: float | None = None  # exclusive bounds of the values still in question
    high: float | None = None
    up_to_low: int = 0  # values at or below ``low``
    below_high: int = 0
    pivots: list[float] = field(default_factory=list)
    answer: float | None = None
    done: bool = False

    def start(self, n: int) -> None:
        self.below_high = n
        self.rank = max(1, math.ceil(Fraction(str(self.quantile)) * n))
        self.done = n == 0

    @property
    def open_rows(self) -> int:
        return self.below_high - self.up_to_low

    def is_open(self) -> Column | None:
        """The rows still in question; None for all of them."""
        bounds = []
        if self.low is not None:
            bounds.append(self.values > F.lit(self.low))
        if self.high is not None:
            bounds.append(self.values < F.lit(self.high))
        return reduce(and_, bounds) if bounds else None

    def open_values(self) -> Column:
        inside = self.is_open()
        return self.values if inside is None else F.when(inside, self.values)

    def spots(self) -> list[float]:
        """Where the wanted rank lies among the open values, and a little to both sides."""
        at = self.quantile
        if self.rank is not None:
            at = (self.rank - self.up_to_low) / self.open_rows
        return [min(1.0, max(0.0, at + step)) for step in (-MARGIN, 0.0, MARGIN)]

    def counts(self) -> Column:
        """Rows below and at or below each pivot."""
        return F.array(
            *[
                F.struct(F.count_if(self.values < F.lit(p)), F.count_if(self.values <= F.lit(p)))
                for p in self.pivots
            ]
        )

    def narrow(self, counts: list[Row]) -> None:
        before = (self.low, self.high)
        for pivot, (below, up_to) in zip(self.pivots, counts):
            if below < self.rank <= up_to:
                self.answer, self.done = pivot, True
                return
            if self.up_to_low <= up_to < self.rank:
                self.low, self.up_to_low = pivot, up_to
            elif self.rank <= below <= self.below_high:
                self.high, self.below_high = pivot, below
        if (self.low, self.high) == before:
            raise ChangingSource("the source changed between two passes over it")


def _propose(rows: DataFrame, searches: dict[tuple, _Search]) -> None:
    """Set pivots; searches over the same open values share one sketch and learn their number."""
    sharing: dict[tuple, list[_Search]] = {}
    for (column, where, _), search in searches.items():
        sharing.setdefault((column, where, search.low, search.high), []).append(search)
    asked = [
        F.struct(
            F.count(group[0].open_values()),
            F.percentile_approx(
                group[0].open_values(), [spot for search in group for spot in search.spots()], ACCURACY
            ),
        )
        for group in sharing.values()
    ]
    found = _together(_open_rows(rows, searches.values()), asked)
    for group, (n, pivots) in zip(sharing.values(), found):
        for i, search in enumerate(group):
            if search.rank is None:
                search.start(n)
            search.pivots = sorted(set(pivots[3 * i : 3 * i + 3])) if n else []


def _open_rows(rows: DataFrame, searches: Iterable[_Search]) -> DataFrame:
    """Only rows that some search still asks for, which clustered files can prune by."""
    conditions = [search.is_open() for search in searches]
    return rows if any(c is None for c in conditions) else rows.filter(reduce(or_, conditions))


def _together(rows: DataFrame, columns: list[Column]) -> Row:
    return rows.agg(*[column.alias(f"c{i}") for i, column in enumerate(columns)]).first()


def exact_quantiles(
    df: DataFrame, wanted: Iterable[tuple[str, str | None, float]]
) -> dict[tuple[str, str | None, float], float | None]:
    """The value at rank ``ceil(q n)`` for each ``(column, where, q)``; None without values."""
    wanted = list(dict.fromkeys(wanted))
    conditions = {where for _, where, _ in wanted}
    shared = len(conditions) == 1 and None not in conditions
    rows = df.filter(F.expr(*conditions)) if shared else df
    searches = {}
    for column, where, quantile in wanted:
        scope = Scope(df.schema, None if shared else where)
        values = scope.kept(scope.column(column).cast("double"))
        searches[column, where, quantile] = _Search(values, quantile)

    def running() -> dict[tuple, _Search]:
        return {key: search for key, search in searches.items() if not search.done}

    while running():
        _propose(rows, running())
        if running():
            counted = _together(rows, [search.counts() for search in running().values()])
            for search, counts in zip(list(running().values()), counted):
                search.narrow(counts)
    return {key: search.answer for key, search in searches.items()}

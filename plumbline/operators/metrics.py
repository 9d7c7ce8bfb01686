"""The metrics a run can compute, as values that describe themselves.

A metric names its columns and an optional SQL row condition ``where``.  How it is computed
depends on its family:

* ``ScanMetric``: one or more aggregate expressions, all of which share a single scan;
* ``FrequencyMetric``: read off the counts per distinct value of a column set;
* ``ApproxQuantiles``/``ApproxQuantile`` with error 0: exact selection (``quantiles``);
* ``ContainedInTable``: value counts against a reference table (``containment``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import patterns
from plumbline.functions.columns import find_field, quoted

Outputs = list[tuple[str, Column]]


class Scope:
    """Columns of one table, and the rows of it that count for a metric."""

    def __init__(self, schema: T.StructType, where: str | None):
        self.schema = schema
        self.where = where
        self._columns: dict[str, Column] = {}

    def field(self, name: str) -> T.StructField:
        return find_field(self.schema, name)

    def column(self, name: str) -> Column:
        if name not in self._columns:
            self._columns[name] = quoted(self.field(name).name)
        return self._columns[name]

    @cached_property
    def condition(self) -> Column | None:
        return None if self.where is None else F.expr(self.where)

    @cached_property
    def rows(self) -> Column:
        return F.count(F.lit(1)) if self.where is None else F.count_if(self.condition)

    def kept(self, value: Column) -> Column:
        """``value`` in the rows that count, NULL elsewhere, where aggregates pass it over."""
        return value if self.where is None else F.when(self.condition, value)

    def count_if(self, condition: Column) -> Column:
        return F.count_if(condition if self.where is None else self.condition & condition)


def _names(columns: str | Sequence[str]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


@dataclass(frozen=True)
class Metric:
    """What every metric offers; the subclasses below are the ones to use."""

    family: ClassVar[str] = ""
    needs: ClassVar[str] = "any"

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    @property
    def entity(self) -> str:
        return "Column" if len(self.columns) == 1 else "Multicolumn"

    @property
    def instance(self) -> str:
        return ",".join(self.columns)

    @property
    def conditions(self) -> tuple[str, ...]:
        """SQL texts that must be boolean over the input table."""
        return () if self.where is None else (self.where,)

    @property
    def pattern_text(self) -> str | None:
        """A regular expression that must compile."""
        return None

    def fault(self) -> str | None:
        """What is wrong with the parameters themselves, if anything."""
        return None

    @property
    def identity(self) -> str:
        """A text that no two different metrics share, the same in every session."""
        return repr(self)

    def __str__(self) -> str:
        given = f"{self.instance} | {self.where}" if self.where else self.instance
        return f"{self.name}({given})"


# --------------------------------------------------------------------------- one shared scan


@dataclass(frozen=True)
class ScanMetric(Metric):
    family: ClassVar[str] = "scan"
    sketch: ClassVar[bool] = False  # whether its aggregate keeps a sketch

    def outputs(self, scope: Scope) -> Outputs:
        return [(self.name, self.value(scope))]

    def value(self, scope: Scope) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Size(ScanMetric):
    where: str | None = None

    columns = ()
    entity = "Dataset"
    instance = "*"

    def value(self, scope: Scope) -> Column:
        return scope.rows


@dataclass(frozen=True)
class Share(ScanMetric):
    """Rows where a condition is TRUE over all rows; a NULL condition counts as not met."""

    def holds(self, scope: Scope) -> Column:
        raise NotImplementedError

    def value(self, scope: Scope) -> Column:
        return F.try_divide(scope.count_if(self.holds(scope)), scope.rows)


@dataclass(frozen=True)
class Completeness(Share):
    column: str
    where: str | None = None

    def holds(self, scope: Scope) -> Column:
        return scope.column(self.column).isNotNull()


@dataclass(frozen=True)
class Compliance(Share):
    """A SQL predicate holds; its label defaults to the predicate."""

    label: str
    predicate: str | None = None
    where: str | None = None

    columns = ()
    entity = "Column"

    @property
    def instance(self) -> str:
        return self.label

    @property
    def condition(self) -> str:
        return self.label if self.predicate is None else self.predicate

    @property
    def conditions(self) -> tuple[str, ...]:
        return (*super().conditions, self.condition)

    def holds(self, scope: Scope) -> Column:
        return F.expr(self.condition)


@dataclass(frozen=True)
class ContainedIn(Share):
    """The value, read as text, is NULL or one of a few literals."""

    column: str
    allowed: tuple[str, ...]
    where: str | None = None

    name = "Compliance"

    @property
    def instance(self) -> str:
        return f"{self.column} contained in {','.join(self.allowed)}"

    def holds(self, scope: Scope) -> Column:
        value = scope.column(self.column)
        known = value.cast("string").isin(*self.allowed) if self.allowed else F.lit(False)
        return value.isNull() | known


@dataclass(frozen=True)
class ApproxCountDistinct(ScanMetric):
    column: str
    where: str | None = None
    relativeDeviation: float = 0.05

    needs: ClassVar[str] = "groupable"
    sketch: ClassVar[bool] = True

    def fault(self) -> str | None:
        return None if 0 < self.relativeDeviation <= 0.39 else "relative deviation outside (0, 0.39]"

    def value(self, scope: Scope) -> Column:
        kept = scope.kept(scope.column(self.column))
        return F.approx_count_distinct(kept, self.relativeDeviation)


@dataclass(frozen=True)
class Correlation(ScanMetric):
    """Pearson correlation over the rows where both columns are present."""

    firstColumn: str
    secondColumn: str
    where: str | None = None

    needs: ClassVar[str] = "numeric"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.firstColumn, self.secondColumn)

    def value(self, scope: Scope) -> Column:
        first, second = (scope.column(name).cast("double") for name in self.columns)
        return F.corr(scope.kept(first), second)


@dataclass(frozen=True)
class DataType(ScanMetric):
    """How many values look like which type; typed columns count as their schema says."""

    column: str
    where: str | None = None

    CLASSES: ClassVar[tuple[str, ...]] = ("Unknown", "Integral", "Fractional", "Boolean", "String")

    def counts(self, scope: Scope) -> list[Column]:
        value, data_type = scope.column(self.column), scope.field(self.column).dataType
        present = scope.count_if(value.isNotNull())
        nothing = F.lit(0).cast("bigint")
        seen = dict.fromkeys(self.CLASSES, nothing)
        seen["Unknown"] = scope.count_if(value.isNull())
        if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
            # Signs, blank, point and digits all sort before ":", which spares most words the patterns.
            numeral = value < ":"
            seen["Integral"] = scope.count_if(numeral & value.rlike(patterns.INTEGRAL))
            seen["Fractional"] = scope.count_if(numeral & value.rlike(patterns.FRACTIONAL))
            seen["Boolean"] = scope.count_if(value.isin(*patterns.BOOLEANS))
            seen["String"] = present - seen["Integral"] - seen["Fractional"] - seen["Boolean"]
        elif isinstance(data_type, T.IntegralType):
            seen["Integral"] = present
        elif isinstance(data_type, (T.FractionalType, T.DecimalType)):
            seen["Fractional"] = present
        elif isinstance(data_type, T.BooleanType):
            seen["Boolean"] = present
        else:
            seen["String"] = present
        return [seen[name] for name in self.CLASSES]

    def outputs(self, scope: Scope) -> Outputs:
        counted = list(zip(self.CLASSES, self.counts(scope)))
        absolute = [(f"DataType.abs.{kind}", count) for kind, count in counted]
        return absolute + [
            (f"DataType.ratio.{kind}", F.try_divide(count, scope.rows)) for kind, count in counted
        ]


@dataclass(frozen=True)
class PatternMatch(Share):
    """A regular expression matches somewhere in the text.

    ``literal`` may name a text that every match holds, to pass over other values cheaply.
    """

    column: str
    pattern: str
    where: str | None = None
    literal: str | None = None

    needs: ClassVar[str] = "text"

    @property
    def pattern_text(self) -> str | None:
        return self.pattern

    def holds(self, scope: Scope) -> Column:
        text = scope.column(self.column)
        found = text.rlike(self.pattern)
        return found if self.literal is None else text.contains(self.literal) & found


@dataclass(frozen=True)
class _OneColumn(ScanMetric):
    column: str
    where: str | None = None

    aggregate: ClassVar[Callable[[Column], Column]]

    def value(self, scope: Scope) -> Column:
        return type(self).aggregate(scope.kept(scope.column(self.column)))


class Minimum(_OneColumn):
    needs = "numeric"
    aggregate = staticmethod(F.min)


class Maximum(_OneColumn):
    needs = "numeric"
    aggregate = staticmethod(F.max)


class Mean(_OneColumn):
    needs = "numeric"
    aggregate = staticmethod(lambda value: F.avg(value.cast("double")))


class Sum(_OneColumn):
    needs = "numeric"
    aggregate = staticmethod(lambda value: F.sum(value.cast("double")))


class StandardDeviation(_OneColumn):
    """Population standard deviation."""

    needs = "numeric"
    aggregate = staticmethod(lambda value: F.stddev_pop(value.cast("double")))


class MinLength(_OneColumn):
    needs = "text"
    aggregate = staticmethod(lambda value: F.min(F.length(value)))


class MaxLength(_OneColumn):
    needs = "text"
    aggregate = staticmethod(lambda value: F.max(F.length(value)))


@dataclass(frozen=True)
class ApproxQuantiles(ScanMetric):
    """Quantiles within a relative rank error; an error of 0 asks for the exact values."""

    column: str
    quantiles: tuple[float, ...]
    relativeError: float = 0.01
    where: str | None = None

    needs: ClassVar[str] = "numeric"
    sketch: ClassVar[bool] = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "quantiles", tuple(self.quantiles))

    @property
    def family(self) -> str:
        return "selection" if self.relativeError == 0 else "scan"

    def fault(self) -> str | None:
        if not self.quantiles or not all(0 <= q <= 1 for q in self.quantiles):
            return "quantiles must lie in [0, 1]"
        return None if 0 <= self.relativeError <= 1 else "relative error outside [0, 1]"

    @property
    def accuracy(self) -> int:
        return max(1, math.ceil(1 / self.relativeError))

    def labels(self) -> list[str]:
        return [f"{self.name}-{q}" for q in self.quantiles]

    def outputs(self, scope: Scope) -> Outputs:
        kept = scope.kept(scope.column(self.column).cast("double"))
        found = F.percentile_approx(kept, list(self.quantiles), self.accuracy)
        return [(label, found[i]) for i, label in enumerate(self.labels())]


@dataclass(frozen=True)
class ApproxQuantile(ScanMetric):
    column: str
    quantile: float
    relativeError: float = 0.01
    where: str | None = None

    needs: ClassVar[str] = "numeric"
    sketch: ClassVar[bool] = True

    @property
    def quantiles(self) -> tuple[float, ...]:
        return (self.quantile,)

    family = ApproxQuantiles.family
    accuracy = ApproxQuantiles.accuracy
    fault = ApproxQuantiles.fault
    labels = ApproxQuantiles.labels
    outputs = ApproxQuantiles.outputs


# ------------------------------------------------------------------- counts per distinct value


class Tally:
    """Aggregates over a frequency table: one row per distinct key, with its ``count``."""

    def __init__(self, keys: Sequence[Column], count: Column):
        present = F.coalesce(*[F.when(key.isNotNull(), True) for key in keys], F.lit(False))
        counted = F.when(present, count)
        self.groups = F.count_if(present)
        self.rows = F.sum(counted)
        self.single = F.count_if(present & (count == 1))
        self.bins = F.count(F.lit(1))
        self.spread = F.sum(counted * F.ln(counted))


@dataclass(frozen=True)
class FrequencyMetric(Metric):
    family: ClassVar[str] = "frequency"
    needs: ClassVar[str] = "groupable"

    def outputs(self, tally: Tally) -> Outputs:
        return [(self.name, self.value(tally))]

    def value(self, tally: Tally) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class _ColumnSet(FrequencyMetric):
    columnNames: tuple[str, ...]
    where: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "columnNames", _names(self.columnNames))

    @property
    def columns(self) -> tuple[str, ...]:
        return self.columnNames

    def fault(self) -> str | None:
        return None if self.columns else "no columns given"


class CountDistinct(_ColumnSet):
    """Distinct tuples with at least one member present."""

    def value(self, tally: Tally) -> Column:
        return tally.groups


class Distinctness(_ColumnSet):
    """Distinct tuples over rows."""

    def value(self, tally: Tally) -> Column:
        return F.try_divide(tally.groups, tally.rows)


class Uniqueness(_ColumnSet):
    """Tuples occurring exactly once over rows."""

    def value(self, tally: Tally) -> Column:
        return F.try_divide(tally.single, tally.rows)


class UniqueValueRatio(_ColumnSet):
    """Tuples occurring exactly once over distinct tuples."""

    def value(self, tally: Tally) -> Column:
        return F.try_divide(tally.single, tally.groups)


@dataclass(frozen=True)
class Entropy(FrequencyMetric):
    """Entropy of the present values, in nats: ``-sum p ln p = ln N - sum(c ln c) / N``."""

    column: str
    where: str | None = None

    def value(self, tally: Tally) -> Column:
        return F.ln(tally.rows) - tally.spread / tally.rows


@dataclass(frozen=True)
class Histogram(FrequencyMetric):
    """Number of distinct values, NULL among them, and counts and shares of each.

    With ``maxDetailBins`` only those of the commonest are given; ties go to the lesser text.  NULL has the
    bin ``NullValue``; a text that reads so too, after any backslashes, gets one more backslash before it.
    """

    column: str
    maxDetailBins: int | None = None
    where: str | None = None

    NULL_BIN: ClassVar[str] = "NullValue"

    def fault(self) -> str | None:
        return "a negative number of bins" if (self.maxDetailBins or 0) < 0 else None

    def outputs(self, tally: Tally) -> Outputs:
        return [("Histogram.bins", tally.bins)]


@dataclass(frozen=True)
class MutualInformation(_ColumnSet):
    """How much one column tells about another, in nats, over rows with both present."""

    def fault(self) -> str | None:
        return None if len(self.columns) == 2 else "exactly two columns are needed"

    def outputs(self, tally: Tally) -> Outputs:
        return []


# ------------------------------------------------------------------------- against another table


@dataclass(frozen=True)
class ContainedInTable(Metric):
    """Share of rows whose value, read as text, is NULL or occurs in a reference column.

    Frames compare by identity, so metrics are equal that use the same frame object.  ``label`` names the
    reference in results and in a history, where the frame itself is not known; it defaults to its column.
    """

    column: str
    reference: DataFrame
    where: str | None = None
    label: str | None = None

    family: ClassVar[str] = "containment"
    needs: ClassVar[str] = "groupable"
    name = "Compliance"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ContainedInTable) and self._identity() == other._identity()

    def __hash__(self) -> int:
        return hash(self._identity())

    def _identity(self) -> tuple:
        return (self.column, id(self.reference), self.where, self.label)

    @property
    def listed(self) -> str:
        return self.label or self.reference.columns[0]

    @property
    def identity(self) -> str:
        return f"ContainedInTable(column={self.column!r}, reference={self.listed!r}, where={self.where!r})"

    @property
    def instance(self) -> str:
        return f"{self.column} contained in {self.listed}"

    def fault(self) -> str | None:
        return None if len(self.reference.columns) == 1 else "the reference must have one column"

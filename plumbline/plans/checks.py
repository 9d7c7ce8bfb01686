"""Checks: named groups of constraints on metrics, with a severity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions import patterns
from plumbline.operators.metrics import (
    Completeness,
    Compliance,
    ContainedIn,
    ContainedInTable,
    DataType,
    Metric,
    PatternMatch,
    Size,
    Uniqueness,
)


class CheckLevel(Enum):
    Error = "Error"
    Warning = "Warning"


@dataclass(frozen=True)
class Against:
    """An assertion on a value and on further metrics, which join the same run.

    ``Against(lambda size, big: size >= 2 * big, Size(where="price > 100"))``
    """

    predicate: Callable[..., bool]
    metrics: tuple[Metric, ...]

    def __init__(self, predicate: Callable[..., bool], *metrics: Metric):
        object.__setattr__(self, "predicate", predicate)
        object.__setattr__(self, "metrics", metrics)


def close_to(expected: float, tolerance: float = 1e-9) -> Callable[[float], bool]:
    """Equality of doubles up to a tolerance."""
    return lambda value: abs(value - expected) <= tolerance


# A Python predicate, a SQL text over ``value``, or a comparison with further metrics.
Assertion = Callable[[float], bool] | str | Against


def as_spark_text(value: object) -> str:
    """A Python value as Spark casts it to text."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def is_one(value: float) -> bool:
    return value == 1.0


@dataclass(frozen=True)
class Constraint:
    text: str
    metric: Metric
    assertion: Assertion
    hint: str | None = None

    def needed(self) -> list[Metric]:
        bounds = self.assertion.metrics if isinstance(self.assertion, Against) else ()
        return [self.metric, *bounds]


class Check:
    """A chain of constraints: ``Check(spark, CheckLevel.Error, "name").isComplete("a")``."""

    def __init__(self, spark: SparkSession, level: CheckLevel, description: str):
        self.level = level
        self.description = description
        self.constraints: list[Constraint] = []

    def _add(
        self, kind: str, metric: Metric, assertion: Assertion, hint: str | None, detail: str = ""
    ) -> Check:
        text = f"{kind}({', '.join(filter(None, [','.join(metric.columns), detail]))})"
        self.constraints.append(Constraint(text, metric, assertion, hint))
        return self

    def hasSize(self, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("hasSize", Size(), assertion, hint)

    def hasCompleteness(self, column: str, assertion: Assertion, hint: str | None = None) -> Check:
        return self._add("hasCompleteness", Completeness(column), assertion, hint)

    def isComplete(self, column: str, hint: str | None = None) -> Check:
        return self._add("isComplete", Completeness(column), is_one, hint)

    def isContainedIn(
        self,
        column: str,
        allowed: Sequence[object] | DataFrame,
        assertion: Assertion = is_one,
        hint: str | None = None,
        label: str | None = None,
    ) -> Check:
        """``allowed`` is a short list, or a one-column frame of any size, which ``label`` may name."""
        if isinstance(allowed, DataFrame):
            metric = ContainedInTable(column, allowed, label=label)
            detail = metric.listed
        else:
            metric = ContainedIn(column, tuple(as_spark_text(v) for v in allowed if v is not None))
            detail = "[" + ",".join(metric.allowed) + "]"
        return self._add("isContainedIn", metric, assertion, hint, detail)

    def containsEmail(self, column: str, assertion: Assertion = is_one, hint: str | None = None) -> Check:
        metric = PatternMatch(column, patterns.EMAIL, literal="@")
        return self._add("containsEmail", metric, assertion, hint)

    def containsSocialSecurityNumber(
        self, column: str, assertion: Assertion = is_one, hint: str | None = None
    ) -> Check:
        metric = PatternMatch(column, patterns.SOCIAL_SECURITY_NUMBER)
        return self._add("containsSocialSecurityNumber", metric, assertion, hint)

    def isUnique(self, column: str, hint: str | None = None) -> Check:
        return self._add("isUnique", Uniqueness(column), is_one, hint)

    def isNonNegative(self, column: str, hint: str | None = None) -> Check:
        """As suggested for numbers; NULL passes."""
        name = column.replace("`", "``")
        metric = Compliance(f"{column} is non-negative", f"coalesce(`{name}`, 0) >= 0")
        return self._add("isNonNegative", metric, is_one, hint, column)

    def hasDataType(self, column: str, kind: str, hint: str | None = None) -> Check:
        """As suggested for text that holds one type; NULL passes, integers are fractionals."""
        return self._add("hasDataType", DataType(column), OfType(kind), hint, kind)


@dataclass(frozen=True)
class OfType:
    """All present values are of one type; evaluated on the counts per type."""

    kind: str

    def __call__(self, counts: dict[str, float]) -> bool:
        present = sum(counts[name] for name in DataType.CLASSES if name != "Unknown")
        fitting = counts[self.kind] + (counts["Integral"] if self.kind == "Fractional" else 0)
        return fitting == present

"""Constraint suggestion: profile every column, then apply rules to the profile.

The profile is one fused analysis run.  The value counts of all columns that may have few values come from
one further pass, and exact uniqueness of all complete columns from a last one.  What is few is a parameter,
``few_values``, and decided on exact counts; estimates only tell which columns are out of the question, by
five times their standard deviation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, astuple, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import patterns
from plumbline.functions.columns import quoted
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    Completeness,
    DataType,
    Maximum,
    Mean,
    Metric,
    Minimum,
    Size,
    StandardDeviation,
    Uniqueness,
)
from plumbline.operators.rows import small_frame
from plumbline.operators.validation import SUITS
from plumbline.plans.evaluation import evaluate
from plumbline.sources.frames import as_spark_frame

FEW_VALUES = 100
SEEN_ONCE_AT_MOST = 0.1
COVERAGE = 0.9
DEVIATION = 0.05
CONFIDENCE = 1.96
SURELY = 1 + 5 * DEVIATION

SUGGESTION_SCHEMA = (
    "column_name string, rule string, constraint string, sql_predicate string, "
    "current_value double, description string"
)


@dataclass
class ColumnProfile:
    name: str
    data_type: T.DataType
    size: int
    completeness: float | None = None
    approx_distinct: float | None = None
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    deviation: float | None = None
    types: dict[str, float] = field(default_factory=dict)
    common: list[str] = field(default_factory=list)  # smallest set of top values that covers enough
    common_share: float = 0.0  # of present rows
    common_seen_once: float = 1.0  # share of the common values that occur once
    values: list[str] = field(default_factory=list)
    values_seen_once: float = 1.0
    unique: bool = False

    @property
    def is_text(self) -> bool:
        return SUITS["text"](self.data_type)

    @property
    def is_numeric(self) -> bool:
        return SUITS["numeric"](self.data_type)

    @property
    def sql_name(self) -> str:
        return "`" + self.name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Suggestion:
    column_name: str
    rule: str
    constraint: str
    sql_predicate: str
    current_value: float
    description: str


@dataclass(frozen=True)
class Rule:
    """Turns a column's profile into a suggestion; ``needs`` names what it reads of the profile."""

    suggest: Callable[[ColumnProfile], Suggestion | None]
    needs: frozenset[str]
    few_values: int = FEW_VALUES  # the most values that a range may list


    def suits(self, p: ColumnProfile) -> bool:
        return "values" not in self.needs or len(p.values) <= self.few_values


def rule(*needs: str) -> Callable[[Callable[[ColumnProfile], Suggestion | None]], Rule]:
    return lambda suggest: Rule(suggest, frozenset(needs))


def _text_list(values: Sequence[str]) -> str:
    return ", ".join("'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" for value in values)


@rule("completeness")
def complete_if_complete(p: ColumnProfile) -> Suggestion | None:
    if p.completeness != 1.0:
        return None
    return Suggestion(
        p.name,
        "CompleteIfComplete",
        f".isComplete({p.name!r})",
        f"{p.sql_name} IS NOT NULL",
        p.completeness,
        f"{p.name} has no NULL",
    )


@rule("completeness")
def retain_completeness(p: ColumnProfile) -> Suggestion | None:
    c = p.completeness
    if c is None or not 0.2 < c < 1:
        return None
    bound = math.floor((c - CONFIDENCE * math.sqrt(c * (1 - c) / p.size)) * 100) / 100
    return Suggestion(
        p.name,
        "RetainCompleteness",
        f".hasCompleteness({p.name!r}, 'value >= {bound}')",
        f"{p.sql_name} IS NOT NULL",
        c,
        f"at least {bound} of {p.name} is present",
    )


@rule("types")
def retain_type(p: ColumnProfile) -> Suggestion | None:
    present = sum(count for kind, count in p.types.items() if kind != "Unknown")
    if not p.is_text or not present:
        return None
    integral, fractional = p.types["Integral"], p.types["Fractional"]
    if integral == present:
        kind, holds = "Integral", f"RLIKE r'{patterns.INTEGRAL}'"
    elif integral + fractional == present:
        kind, holds = "Fractional", f"RLIKE r'{patterns.INTEGRAL}|{patterns.FRACTIONAL}'"
    elif p.types["Boolean"] == present:
        kind, holds = "Boolean", f"IN ({_text_list(patterns.BOOLEANS)})"
    else:
        return None
    return Suggestion(
        p.name,
        "RetainType",
        f".hasDataType({p.name!r}, {kind!r})",
        f"{p.sql_name} IS NULL OR {p.sql_name} {holds}",
        1.0,
        f"all values of {p.name} read as {kind}",
    )


def _categorical(p: ColumnProfile) -> bool:
    return p.is_text and bool(p.values) and p.values_seen_once <= SEEN_ONCE_AT_MOST


@rule("values")
def categorical_range(p: ColumnProfile) -> Suggestion | None:
    if not _categorical(p):
        return None
    return Suggestion(
        p.name,
        "CategoricalRange",
        f".isContainedIn({p.name!r}, {p.values!r})",
        f"{p.sql_name} IS NULL OR {p.sql_name} IN ({_text_list(p.values)})",
        1.0,
        f"{p.name} holds one of {len(p.values)} values",
    )


@rule("completeness", "values")
def fractional_categorical_range(p: ColumnProfile) -> Suggestion | None:
    if not p.is_text or not p.common or _categorical(p) or p.common_seen_once > SEEN_ONCE_AT_MOST:
        return None
    present = p.size * p.completeness
    share = (p.size - present + p.common_share * present) / p.size  # NULL passes
    spread = CONFIDENCE * math.sqrt(share * (1 - share) / p.size)
    bound = math.floor((share - spread) * 100) / 100
    return Suggestion(
        p.name,
        "FractionalCategoricalRange",
        f".isContainedIn({p.name!r}, {p.common!r}, 'value >= {bound}')",
        f"{p.sql_name} IS NULL OR {p.sql_name} IN ({_text_list(p.common)})",
        p.common_share,
        f"{p.name} mostly holds one of {len(p.common)} values",
    )


@rule("minimum")
def non_negative_numbers(p: ColumnProfile) -> Suggestion | None:
    if not p.is_numeric or p.minimum is None or p.minimum < 0:
        return None
    return Suggestion(
        p.name,
        "NonNegativeNumbers",
        f".isNonNegative({p.name!r})",
        f"{p.sql_name} IS NULL OR {p.sql_name} >= 0",
        p.minimum,
        f"{p.name} has no negative value",
    )


@rule("unique")
def unique_if_unique(p: ColumnProfile) -> Suggestion | None:
    if not p.unique:
        return None
    return Suggestion(
        p.name,
        "UniqueIfUnique",
        f".isUnique({p.name!r})",
        f"count(*) OVER (PARTITION BY {p.sql_name}) = 1",
        1.0,
        f"every value of {p.name} occurs once",
    )


def DEFAULT(few_values: int = FEW_VALUES) -> list[Rule]:
    """All rules; a range lists at most ``few_values``."""
    rules = [
        complete_if_complete,
        retain_completeness,
        retain_type,
        categorical_range,
        fractional_categorical_range,
        non_negative_numbers,
        unique_if_unique,
    ]
    return [replace(one, few_values=few_values) for one in rules]


STATISTICS = frozenset(
    ["completeness", "approx_distinct", "types", "minimum", "maximum", "mean", "deviation"]
)


def profile(
    df: DataFrame, needs: frozenset[str] = STATISTICS, few_values: int = FEW_VALUES
) -> list[ColumnProfile]:
    """Profile every column as far as needed.

    Only scalars and the values of low-cardinality columns come back.
    """
    fields = df.schema.fields
    asked: dict[str, dict[str, Metric]] = {}
    for column in fields:
        name = column.name
        suited = {"completeness": Completeness(name)}
        distinct = "approx_distinct" in needs or "values" in needs and SUITS["text"](column.dataType)
        if distinct and SUITS["groupable"](column.dataType):
            suited["approx_distinct"] = ApproxCountDistinct(name, relativeDeviation=DEVIATION)
        if SUITS["text"](column.dataType):
            suited["types"] = DataType(name)
        if SUITS["numeric"](column.dataType):
            suited |= {
                "minimum": Minimum(name),
                "maximum": Maximum(name),
                "mean": Mean(name),
                "deviation": StandardDeviation(name),
            }
        always = {"completeness", "approx_distinct"} if "unique" in needs else {"approx_distinct"}
        asked[name] = {key: metric for key, metric in suited.items() if key in needs | always}
    found = evaluate(df, [Size(), *[metric for wanted in asked.values() for metric in wanted.values()]])
    size = int(found.value(Size()))

    profiles = []
    for column in fields:
        p = ColumnProfile(column.name, column.dataType, size)
        for attribute, metric in asked[column.name].items():
            if attribute == "types":
                p.types = found.parts(metric, "DataType.abs.")
            else:
                setattr(p, attribute, found.value(metric))
        profiles.append(p)
    if "values" in needs:
        few = [p for p in profiles if p.is_text and 0 < (p.approx_distinct or 0) <= few_values * SURELY]
        _add_value_counts(df, few, few_values)
    if "unique" in needs:
        groupable = [p for p in profiles if p.completeness == 1.0 and SUITS["groupable"](p.data_type)]
        _add_uniqueness(df, groupable)
    return profiles


PROFILE_SCHEMA = (
    "column_name string, data_type string, size bigint, completeness double, approx_distinct double, "
    "minimum double, maximum double, mean double, deviation double"
)


def profile_frame(df: DataFrame) -> DataFrame:
    """The profile as a table, one row per column."""
    rows = [
        (
            p.name,
            p.data_type.simpleString(),
            p.size,
            p.completeness,
            p.approx_distinct,
            p.minimum,
            p.maximum,
            p.mean,
            p.deviation,
        )
        for p in profile(df)
    ]
    return small_frame(df.sparkSession, rows, PROFILE_SCHEMA)


def _add_uniqueness(df: DataFrame, profiles: list[ColumnProfile]) -> None:
    """Test exactly: one grouping per column, all in one run, for Spark to schedule as it can."""
    found = evaluate(df, [Uniqueness(p.name) for p in profiles])
    for p in profiles:
        p.unique = found.value(Uniqueness(p.name)) == 1.0


def _add_value_counts(df: DataFrame, profiles: list[ColumnProfile], few_values: int) -> None:
    """Value counts of all given columns in one pass: each row gives one pair per column.

    The pairs combine on the map side, and a column has near ``few_values`` values at most; those that
    prove to have more are left without.
    """
    if not profiles:
        return
    pairs = F.array(
        *[F.struct(F.lit(i).alias("column"), quoted(p.name).alias("value")) for i, p in enumerate(profiles)]
    )
    counts = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = W.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    before = F.sum("count").over(ranked.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")
    total = F.sum("count").over(W.partitionBy("column"))
    common = before < COVERAGE * total
    summary = (
        counts.select("column", "value", "count", common.alias("common"), total.alias("total"))
        .groupBy("column")
        .agg(
            F.sort_array(F.collect_list("value")).alias("values"),
            F.sort_array(F.collect_list(F.when(F.col("common"), F.col("value")))).alias("top"),
            F.try_divide(F.count_if(F.col("count") == 1), F.count("*")).alias("once"),
            F.try_divide(F.count_if(F.col("common") & (F.col("count") == 1)), F.count_if("common")).alias(
                "top_once"
            ),
            (F.sum(F.when(F.col("common"), F.col("count"))) / F.first("total")).alias("top_share"),
        )
    )
    for row in summary.where(F.size("values") <= few_values).collect():
        p = profiles[row["column"]]
        p.values, p.values_seen_once = row["values"], row["once"]
        p.common, p.common_seen_once, p.common_share = row["top"], row["top_once"], row["top_share"]


class ConstraintSuggestionRunner:
    def __init__(self, spark: SparkSession):
        self._spark = spark

    def onData(self, df) -> ConstraintSuggestionBuilder:
        return ConstraintSuggestionBuilder(self._spark, as_spark_frame(self._spark, df))


class ConstraintSuggestionBuilder:
    def __init__(self, spark: SparkSession, df: DataFrame):
        self._spark = spark
        self._df = df
        self._rules: list[Rule] = []

    def addConstraintRule(self, added: Rule | Sequence[Rule]) -> ConstraintSuggestionBuilder:
        """Add a rule, or a bundle such as ``DEFAULT()``."""
        self._rules += [added] if isinstance(added, Rule) else list(added)
        return self

    def run(self) -> Suggestions:
        needs = frozenset().union(*[one.needs for one in self._rules])
        few = max([one.few_values for one in self._rules if "values" in one.needs], default=FEW_VALUES)
        profiles = profile(self._df, needs, few)
        found = [one.suggest(p) for p in profiles for one in self._rules if one.suits(p)]
        return Suggestions(self._spark, [suggestion for suggestion in found if suggestion])


@dataclass(frozen=True)
class Suggestions:
    spark: SparkSession
    found: list[Suggestion]

    def as_frame(self) -> DataFrame:
        return small_frame(self.spark, [astuple(one) for one in self.found], SUGGESTION_SCHEMA)

    def as_dict(self) -> dict[str, list[dict]]:
        """The records under the key ``constraint_suggestions``, ready for ``json.dumps``."""
        return {"constraint_suggestions": [asdict(one) for one in self.found]}

    def as_json(self) -> DataFrame:
        """One JSON record per suggestion."""
        frame = self.as_frame()
        return frame.select("column_name", "rule", F.to_json(F.struct(*frame.columns)).alias("record"))

    def head(self, n: int = 5) -> DataFrame:
        return self.as_frame().orderBy("column_name", "rule").limit(n)

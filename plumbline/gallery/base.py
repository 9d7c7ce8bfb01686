"""What the example queries share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.metrics import Metric
from plumbline.plans.analysis import AnalysisRunner

@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


@dataclass(frozen=True)
class Derived:
    """A table with further columns, given by expressions that read the same in both engines."""

    source: str
    columns: Mapping[str, str]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        added = {name: F.expr(text) for name, text in self.columns.items()}
        return table(spark, folder, self.source).withColumns(added)

    @property
    def sql(self) -> str:
        added = ", ".join(f"{text} AS {name}" for name, text in self.columns.items())
        return f"(SELECT *, {added} FROM {self.source})"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# The test tables hold no NULL, so these make some.
ORDERS = Derived("orders", {"priority": "nullif(o_orderpriority, '1-URGENT')"})
LINEITEM = Derived(
    "lineitem",
    {
        "line": "nullif(l_linenumber, 1)",
        "supplier": "CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END",
    },
)
EVENTS = Derived("events", {"kind": "CASE WHEN event_id % 7 <> 0 THEN event_type END"})


def rounded(metrics: DataFrame, digits: int = 6) -> DataFrame:
    return metrics.withColumn("value", F.round("value", digits))


def analysed(df: DataFrame, metrics: Sequence[Metric], digits: int = 6) -> DataFrame:
    """The metrics of a table as a lazy frame, rounded."""
    return rounded(AnalysisRunner(df.sparkSession).onData(df).addAnalyzers(metrics).asDataFrame(), digits)


def expected(rows: Iterable[tuple[str, str, str, str]], digits: int = 6) -> str:
    """SQL for metric rows, from ``(entity, instance, name, query for one value)``."""
    return " UNION ALL ".join(
        f"SELECT '{entity}' AS entity, '{instance}' AS instance, '{name}' AS name, "
        f"round(CAST(({query}) AS DOUBLE), {digits}) AS value"
        for entity, instance, name, query in rows
    )

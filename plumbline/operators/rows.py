"""Metric values in long form: one row per value."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.metrics import Metric, Outputs

# ``position`` is the place of the metric in its run; ``filter`` its row condition; ``metric`` its identity.
LABELS = "array<struct<position:int, entity:string, instance:string, name:string, filter:string, metric:string>>"
SCHEMA = "position int, entity string, instance string, name string, value double, filter string, metric string"


@dataclass(frozen=True)
class Placed:
    """A metric and its place in a run."""

    position: int
    metric: Metric

    def label(self, name: str) -> dict:
        metric = self.metric
        return {
            "position": self.position,
            "entity": metric.entity,
            "instance": metric.instance,
            "name": name,
            "filter": metric.where,
            "metric": metric.identity,
        }

    def local_row(self, name: str, value: float | None) -> tuple:
        metric = self.metric
        return (self.position, metric.entity, metric.instance, name, value, metric.where, metric.identity)


def label_literal(labels: list[dict]) -> Column:
    """Labels as a single literal.

    Built one by one as columns they would take the driver longer than the aggregation they
    describe takes on a small table.
    """
    return F.from_json(F.lit(json.dumps(labels)), LABELS)


def row_struct(label: str, name: str, value: str) -> str:
    """SQL for one long-form row, from SQL for its label, name and value."""
    return (
        f"named_struct('position', {label}.position, 'entity', {label}.entity, 'instance', {label}.instance, "
        f"'name', {name}, 'value', cast({value} AS double), 'filter', {label}.filter, 'metric', {label}.metric)"
    )


# One row per label: the value at the same place of the array ``measured``.
MEASURED_ROWS = f"transform(labels, (label, i) -> {row_struct('label', 'label.name', 'measured[i]')})"


def measured_values(df: DataFrame, outputs: Outputs, *further: Column) -> DataFrame:
    """One row: all aggregates over ``df`` in the array ``measured``, and further aggregates."""
    totals = df.agg(*[value.alias(f"v{i}") for i, (_, value) in enumerate(outputs)], *further)
    doubles = ", ".join(f"cast(v{i} AS double)" for i in range(len(outputs)))
    return totals.withColumn("measured", F.expr(f"array({doubles})"))


def aggregate_rows(df: DataFrame, outputs: Iterable[tuple[Placed, str, Column]]) -> DataFrame:
    """Evaluate aggregates over ``df`` together, and turn the one result row into many."""
    outputs = list(outputs)
    values = measured_values(df, [(name, value) for _, name, value in outputs])
    labels = label_literal([placed.label(name) for placed, name, _ in outputs])
    return values.select("measured", labels.alias("labels")).selectExpr(f"inline({MEASURED_ROWS})")


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few rows that are known on the driver, as one literal in the plan."""
    names = [column.split()[0] for column in schema.split(", ")]
    fields = ", ".join(column.replace(" ", ":", 1) for column in schema.split(", "))
    text = json.dumps([dict(zip(names, row)) for row in rows])
    known = F.from_json(F.lit(text), f"array<struct<{fields}>>")
    return spark.range(1, numPartitions=1).select(F.inline(known))


def local_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return small_frame(spark, rows, SCHEMA)

"""Metrics read off value counts: one grouping pass per column set and row condition.

The grouping combines on the map side, so a value held by a third of all rows reaches the
shuffle as one row per task.  Everything after it works on counts, not on rows.  Filters stay
out of the plans above the grouping: pushed below it they would make its shuffles differ
and keep Spark from reusing one of them for all metrics on the same columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, find_field, quoted
from plumbline.operators.metrics import Histogram, Metric, MutualInformation, Tally
from plumbline.operators.rows import Placed, aggregate_rows

COUNT = "rows in group"


def resolved(df: DataFrame, metric: Metric) -> tuple[str, ...]:
    """The metric's columns by their names in the table, in one order for any spelling."""
    return tuple(sorted({find_field(df.schema, name).name for name in metric.columns}))


def value_counts(df: DataFrame, columns: tuple[str, ...], where: str | None) -> DataFrame:
    """The frequency table: each distinct tuple, named ``k0, k1, ...``, with its count."""
    rows = df if where is None else df.filter(F.expr(where))
    keys = [quoted(name).alias(f"k{i}") for i, name in enumerate(columns)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT))


def sharing_counts(df: DataFrame, metrics: list[Placed]) -> dict[tuple, list[Placed]]:
    """The metrics by the column set and row condition whose counts they need."""
    sharing: dict[tuple, list[Placed]] = {}
    for placed in metrics:
        sharing.setdefault((resolved(df, placed.metric), placed.metric.where), []).append(placed)
    return sharing


def frequency_rows(df: DataFrame, metrics: list[Placed]) -> list[DataFrame]:
    """Long-form rows for all frequency metrics, but for the bins of histograms."""
    frames = []
    for (columns, where), group in (sharing := sharing_counts(df, metrics)).items():
        frames += rows_of_counts(shared_counts(df, columns, where, sharing), len(columns), group)
    return frames


def bin_frames(df: DataFrame, metrics: list[Placed]) -> list[DataFrame]:
    """Long-form rows for the bins of all histograms, as many as the columns have values."""
    frames = []
    for (columns, where), group in (sharing := sharing_counts(df, metrics)).items():
        text = as_text(F.col("k0"), find_field(df.schema, columns[0]).dataType)
        counts = shared_counts(df, columns, where, sharing)
        frames += [bin_rows(counts, text, one) for one in group if isinstance(one.metric, Histogram)]
    return frames


def shared_counts(df: DataFrame, columns: tuple[str, ...], where: str | None, sharing: dict[tuple, list]) -> DataFrame:
    """The counts of a column set: regrouped from those of the smallest set that holds it, if one is needed too."""
    wider = [other for other, condition in sharing if condition == where and set(columns) < set(other)]
    if not wider:
        return value_counts(df, columns, where)
    source = min(wider, key=len)
    keys = [F.col(f"k{source.index(name)}").alias(f"k{i}") for i, name in enumerate(columns)]
    return shared_counts(df, source, where, sharing).groupBy(*keys).agg(F.sum(quoted(COUNT)).alias(COUNT))


def rows_of_counts(counts: DataFrame, keys: int, metrics: list[Placed]) -> list[DataFrame]:
    """Rows of metrics that share a frequency table of so many keys."""
    tally = Tally([F.col(f"k{i}") for i in range(keys)], quoted(COUNT))
    frames = []
    outputs = [
        (placed, name, value) for placed in metrics for name, value in placed.metric.outputs(tally)
    ]
    if outputs:
        frames.append(aggregate_rows(counts, outputs))
    for placed in metrics:
        if isinstance(placed.metric, MutualInformation):
            frames.append(mutual_information(counts, placed, keys))
    return frames


def bin_rows(counts: DataFrame, text: Column, placed: Placed) -> DataFrame:
    """Two rows for each value: its count and its share.  They never leave the executors on their own."""
    label, most = placed.label(""), placed.metric.maxDetailBins
    null_like = text.rlike(rf"\A\\*{Histogram.NULL_BIN}\z")
    name = F.when(text.isNull(), Histogram.NULL_BIN).when(null_like, F.concat(F.lit("\\"), text)).otherwise(text)
    total = counts.agg(F.sum(quoted(COUNT))).scalar()
    bins = counts.select(name.alias("bin"), quoted(COUNT).cast("double").alias("count"))
    if most is not None:
        bins = bins.orderBy(F.desc("count"), "bin").limit(most)
    pairs = [
        F.struct(F.concat(F.lit(f"Histogram.{kind}."), F.col("bin")).alias("name"), value.alias("value"))
        for kind, value in (("abs", F.col("count")), ("ratio", F.col("count") / total))
    ]
    return bins.select(F.inline(F.array(*pairs))).select(
        F.lit(label["position"]).alias("position"),
        F.lit(label["entity"]).alias("entity"),
        F.lit(label["instance"]).alias("instance"),
        "name",
        "value",
        F.lit(label["filter"]).cast("string").alias("filter"),
        F.lit(label["metric"]).alias("metric"),
    )


def mutual_information(counts: DataFrame, placed: Placed, distinct_columns: int) -> DataFrame:
    """``ln N + (S(a,b) - S(a) - S(b)) / N`` with ``S`` the sum of ``c ln c`` over counts.

    The counts of either column alone come from the counts of the pairs, both in one regrouping,
    which carries the sum over the pairs along.  A column paired with itself has one key, and
    the formula then gives its entropy.
    """
    keys = [F.col(f"k{i}") for i in range(distinct_columns)]
    both = reduce(lambda a, b: a & b, [key.isNotNull() for key in keys])
    pairs = F.when(both, quoted(COUNT))
    if distinct_columns == 1:
        rows = F.sum(pairs)
        value = F.ln(rows) - F.sum(pairs * F.ln(pairs)) / rows
        return aggregate_rows(counts, [(placed, placed.metric.name, value)])
    first, second = keys
    alone = counts.groupingSets([[first], [second]], first, second).agg(
        F.grouping_id().alias("set"),
        F.sum(pairs).alias("c"),
        F.sum(pairs * F.ln(pairs)).alias("spread"),
    )
    in_first = F.col("set") == 1
    rows = F.sum(F.when(in_first, F.col("c")))
    of_pairs = F.sum(F.when(in_first, F.col("spread")))
    of_columns = F.sum(F.col("c") * F.ln(F.col("c")))
    value = F.ln(rows) + (of_pairs - of_columns) / rows
    return aggregate_rows(alone, [(placed, placed.metric.name, value)])

"""From a list of metrics to one long DataFrame of values."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.containment import containment_rows
from plumbline.operators.frequency import bin_frames, frequency_rows
from plumbline.operators.metrics import Metric
from plumbline.operators.quantiles import ChangingSource, exact_quantiles
from plumbline.operators.rows import Placed, local_rows, small_frame
from plumbline.operators.scan import scan_rows
from plumbline.operators.validation import Validator, is_data_fault

METRIC_COLUMNS = ["entity", "instance", "name", "value"]
FAILURE_SCHEMA = "entity string, instance string, name string, filter string, error string, message string"


@dataclass(frozen=True)
class Failure:
    metric: Metric
    error: str
    message: str

    def row(self) -> tuple:
        metric = self.metric
        return (metric.entity, metric.instance, metric.name, metric.where, self.error, self.message)


@dataclass
class Evaluation:
    """Scalars that reached the driver, and the bins of histograms as plans that read the table anew."""

    spark: SparkSession
    metrics: list[Metric]
    rows: list[tuple] = field(default_factory=list)  # rows.SCHEMA
    failures: list[Failure] = field(default_factory=list)
    bins: list[DataFrame] = field(default_factory=list)

    def long_frame(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [local_rows(self.spark, self.rows), *self.bins])

    def success_frame(self) -> DataFrame:
        return self.long_frame().select(*METRIC_COLUMNS)

    def failure_frame(self) -> DataFrame:
        return small_frame(self.spark, [failure.row() for failure in self.failures], FAILURE_SCHEMA)

    @cached_property
    def _values(self) -> dict[Metric, dict[str, float]]:
        found: dict[Metric, dict[str, float]] = {}
        for position, _, _, name, value, *_ in self.rows:
            found.setdefault(self.metrics[position], {})[name] = value
        return found

    @cached_property
    def _failed(self) -> dict[Metric, Failure]:
        return {failure.metric: failure for failure in self.failures}

    def value(self, metric: Metric) -> float | None:
        """The value of a metric, or the first of several."""
        return next(iter(self._values.get(metric, {}).values()), None)

    def parts(self, metric: Metric, prefix: str) -> dict[str, float]:
        """The values of a metric that has many, by the rest of their names."""
        named = self._values.get(metric, {})
        return {name.removeprefix(prefix): value for name, value in named.items() if name.startswith(prefix)}

    def failure(self, metric: Metric) -> Failure | None:
        return self._failed.get(metric)


def sort_out(df: DataFrame, metrics: list[Metric]) -> tuple[list[Placed], list[Failure]]:
    """Place the computable metrics, once each; report the others."""
    good, bad, validator = [], [], Validator(df)
    for position, metric in enumerate(metrics):
        fault = validator.fault_of(metric)
        if fault:
            bad.append(Failure(metric, *fault))
        else:
            good.append(Placed(position, metric))
    return good, bad


def metric_frame(df: DataFrame, metrics: list[Placed]) -> DataFrame:
    """One lazy frame of all values but bins; only exact quantiles run jobs of their own beforehand."""
    family = {"scan": [], "selection": [], "frequency": [], "containment": []}
    for placed in metrics:
        family[placed.metric.family].append(placed)
    frames = []
    frames += scan_rows(df, family["scan"])
    if family["selection"]:
        frames.append(selection_rows(df, family["selection"]))
    frames += frequency_rows(df, family["frequency"])
    frames += [containment_rows(df, placed) for placed in family["containment"]]
    return reduce(DataFrame.unionByName, frames) if frames else local_rows(df.sparkSession, [])


def selection_rows(df: DataFrame, metrics: list[Placed]) -> DataFrame:
    def keys(placed: Placed) -> list[tuple]:
        metric = placed.metric
        return [(metric.columns[0], metric.where, quantile) for quantile in metric.quantiles]

    found = exact_quantiles(df, [key for placed in metrics for key in keys(placed)])
    rows = [
        placed.local_row(label, found[key])
        for placed in metrics
        for label, key in zip(placed.metric.labels(), keys(placed))
    ]
    return local_rows(df.sparkSession, rows)


def evaluate(df: DataFrame, metrics: list[Metric]) -> Evaluation:
    """Run once and keep the values, so that later uses do not read the table again."""
    metrics = list(dict.fromkeys(metrics))
    good, bad = sort_out(df, metrics)
    result = Evaluation(df.sparkSession, metrics, failures=bad)
    _run(df, good, result)
    result.rows.sort(key=lambda row: row[0])
    place = {metric: position for position, metric in enumerate(metrics)}
    result.failures.sort(key=lambda failure: place[failure.metric])
    return result


def _run(df: DataFrame, metrics: list[Placed], result: Evaluation) -> None:
    """Run all metrics together.  Should a value break the run, report its metrics and run the rest."""
    if not metrics:
        return
    try:
        rows = [tuple(row) for row in metric_frame(df, metrics).collect()]
    except ChangingSource as error:
        selected = [placed for placed in metrics if placed.metric.family == "selection"]
        result.failures += [Failure(placed.metric, "ChangingSource", str(error)) for placed in selected]
        _run(df, [placed for placed in metrics if placed not in selected], result)
        return
    except PySparkException as error:
        if not is_data_fault(error):
            raise
        for group in _without_culprits(df, metrics, result, error):
            _run(df, group, result)
        return
    result.bins += bin_frames(df, [placed for placed in metrics if placed.metric.family == "frequency"])
    present = [row for row in rows if row[4] is not None]
    result.rows += present
    empty = {row[0] for row in rows} - {row[0] for row in present}
    for placed in metrics:
        if placed.position in empty:
            result.failures.append(Failure(placed.metric, "EmptyState", "no values to compute from"))


def _without_culprits(
    df: DataFrame, metrics: list[Placed], result: Evaluation, error: PySparkException
) -> list[list[Placed]]:
    """What to run after a failure: the metrics whose conditions can be evaluated.

    Conditions are user text, so each combination of them is probed by one pruned count.  If
    none is to blame the metrics are halved until the culprit stands alone.
    """
    combined = {placed.metric.conditions for placed in metrics} - {()}
    broken = {}
    if len(metrics) > 1:
        broken = {texts: fault for texts in combined if (fault := _probe(df, texts)) is not None}
    elif metrics:
        broken = {metrics[0].metric.conditions: error}
    for placed in metrics:
        fault = broken.get(placed.metric.conditions)
        if fault is not None:
            message = f"{fault.getCondition()} while computing"
            result.failures.append(Failure(placed.metric, "BadValue", message))
    if broken:
        return [[placed for placed in metrics if placed.metric.conditions not in broken]]
    middle = len(metrics) // 2
    return [metrics[:middle], metrics[middle:]]


def _probe(df: DataFrame, texts: tuple[str, ...]) -> PySparkException | None:
    try:
        reduce(lambda rows, text: rows.filter(F.expr(text)), texts, df).count()
    except PySparkException as error:
        if not is_data_fault(error):
            raise
        return error
    return None


def lazy_success_frame(df: DataFrame, metrics: list[Metric], failures: bool = False) -> DataFrame:
    """The values as a plan: each action on it reads the table anew.

    A metric that validation refuses is an error here.  With ``failures`` it becomes a row instead, with
    NULL as value and the reason in a further column ``error``; conditions in the user's SQL are then tried on
    the table first, a pruned count for each, so that a value that breaks one takes only its metrics out.
    What has no values to compute from is a row with ``EmptyState``.
    """
    good, bad = sort_out(df, list(dict.fromkeys(metrics)))
    if not failures:
        if bad:
            raise ValueError("; ".join(f"{one.metric}: {one.error}, {one.message}" for one in bad))
        return with_bins(df, good).filter(F.col("value").isNotNull()).select(*METRIC_COLUMNS)
    tried = {texts: _probe(df, texts) for texts in {placed.metric.conditions for placed in good} - {()}}
    bad += [Failure(one.metric, "BadValue", "") for one in good if tried.get(one.metric.conditions) is not None]
    fine = [one for one in good if tried.get(one.metric.conditions) is None]
    # A metric of several values without any is one failure, named as the metric is.  Bins always have a value.
    names = small_frame(
        df.sparkSession, [(one.position, one.metric.name) for one in fine], "position int, asked string"
    )
    empty = F.col("value").isNull()
    rows = metric_frame(df, fine).join(names, "position")
    rows = rows.withColumns({"name": F.when(empty, F.col("asked")).otherwise(F.col("name")), "error": F.when(empty, "EmptyState")})
    failed = [(f.metric.entity, f.metric.instance, f.metric.name, None, f.error) for f in bad]
    told = small_frame(
        df.sparkSession, failed, "entity string, instance string, name string, value double, error string"
    )
    frames = [rows.dropDuplicates(["position", "name"]).select(*METRIC_COLUMNS, "error")]
    for bins in bin_frames(df, [one for one in fine if one.metric.family == "frequency"]):
        frames.append(bins.withColumn("error", F.lit(None).cast("string")).select(*METRIC_COLUMNS, "error"))
    return reduce(DataFrame.unionByName, [*frames, told])


def with_bins(df: DataFrame, metrics: list[Placed]) -> DataFrame:
    counted = [placed for placed in metrics if placed.metric.family == "frequency"]
    return reduce(DataFrame.unionByName, [metric_frame(df, metrics), *bin_frames(df, counted)])

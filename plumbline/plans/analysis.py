"""Analysis runs: metrics over one table, kept in a history when asked to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.metrics import Metric
from plumbline.plans.evaluation import Evaluation, evaluate, lazy_success_frame
from plumbline.sources.frames import as_spark_frame
from plumbline.sources.history import MetricsRepository, ResultKey
from plumbline.sources.stamped import MetricTarget, stamp_and_append


class AnalysisRunner:
    """Computes metrics of a table, sharing scans and grouping passes among them."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def onData(self, df) -> AnalysisRunBuilder:
        """``df`` may be a Spark or a (small) pandas frame."""
        return AnalysisRunBuilder(self._spark, as_spark_frame(self._spark, df))


class AnalysisRunBuilder:
    def __init__(self, spark: SparkSession, df: DataFrame):
        self._spark = spark
        self._df = df
        self._metrics: list[Metric] = []
        self._repository: MetricsRepository | None = None
        self._key: ResultKey | None = None

    def addAnalyzer(self, metric: Metric) -> AnalysisRunBuilder:
        self._metrics.append(metric)
        return self

    def addAnalyzers(self, metrics: Sequence[Metric]) -> AnalysisRunBuilder:
        self._metrics += metrics
        return self

    def useRepository(self, repository: MetricsRepository) -> AnalysisRunBuilder:
        self._repository = repository
        return self

    def saveOrAppendResult(self, key: ResultKey) -> AnalysisRunBuilder:
        self._key = key
        return self

    def run(self) -> Evaluation:
        """Compute now, in as few passes as the metrics allow, and save if a key was given."""
        result = evaluate(self._df, self._metrics)
        save(result, self._repository, self._key)
        return result

    def asDataFrame(self, failures: bool = False) -> DataFrame:
        """The metrics as a lazy frame ``(entity, instance, name, value)``.

        Metrics that cannot be computed are an error, or with ``failures`` rows of their own, which have
        no value and a reason in the further column ``error``.
        """
        return lazy_success_frame(self._df, self._metrics, failures)


def save(result: Evaluation, repository: MetricsRepository | None, key: ResultKey | None) -> None:
    """Save under ``key``; one of the two alone cannot be meant."""
    if (repository is None) != (key is None):
        raise ValueError("saving needs both a repository and a key")
    if repository is not None:
        identities = [metric.identity for metric in result.metrics]
        if len(set(identities)) < len(identities):
            raise ValueError("two reference tables go by one name; give them labels before saving")
        repository.save(key, result.long_frame())


class AnalyzerContext:
    """Views of an analysis result."""

    @staticmethod
    def successMetricsAsDataFrame(spark: SparkSession, result: Evaluation) -> DataFrame:
        return result.success_frame()

    @staticmethod
    def failedMetricsAsDataFrame(spark: SparkSession, result: Evaluation) -> DataFrame:
        return result.failure_frame()

    @staticmethod
    def addUpdateRepository(
        spark: SparkSession, tag_value: str, df_metrics: DataFrame, target: MetricTarget
    ) -> DataFrame:
        return stamp_and_append(df_metrics, target, tag_value)

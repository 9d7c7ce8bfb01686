"""Verification: the metrics of all checks in one run, then their assertions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rows import small_frame
from plumbline.plans.analysis import save
from plumbline.plans.checks import Against, Check, CheckLevel, Constraint, OfType
from plumbline.plans.evaluation import Evaluation, evaluate
from plumbline.sources.frames import as_spark_frame
from plumbline.sources.history import MetricsRepository, ResultKey
from plumbline.sources.stamped import MetricTarget, stamp_and_append

RESULT_SCHEMA = (
    "check string, check_level string, check_status string, "
    "constraint string, constraint_status string, constraint_message string"
)


@dataclass
class Verified:
    """What a verification found: metric values, and the outcome of every constraint."""

    evaluation: Evaluation
    outcomes: list[tuple[Check, Constraint, bool, str]]

    def check_status(self, check: Check) -> str:
        failed = any(not passed for owner, _, passed, _ in self.outcomes if owner is check)
        return check.level.value if failed else "Success"

    @property
    def status(self) -> str:
        found = {self.check_status(check) for check, *_ in self.outcomes}
        worst = [level.value for level in (CheckLevel.Error, CheckLevel.Warning) if level.value in found]
        return (worst or ["Success"])[0]

    def rows(self) -> list[tuple]:
        return [
            (
                check.description,
                check.level.value,
                self.check_status(check),
                constraint.text,
                "Success" if passed else "Failure",
                message,
            )
            for check, constraint, passed, message in self.outcomes
        ]


class VerificationSuite:
    def __init__(self, spark: SparkSession):
        self._spark = spark

    def onData(self, df) -> VerificationRunBuilder:
        return VerificationRunBuilder(self._spark, as_spark_frame(self._spark, df))


class VerificationRunBuilder:
    def __init__(self, spark: SparkSession, df: DataFrame):
        self._spark = spark
        self._df = df
        self._checks: list[Check] = []
        self._repository: MetricsRepository | None = None
        self._key: ResultKey | None = None

    def addCheck(self, check: Check) -> VerificationRunBuilder:
        self._checks.append(check)
        return self

    def useRepository(self, repository: MetricsRepository) -> VerificationRunBuilder:
        self._repository = repository
        return self

    def saveOrAppendResult(self, key: ResultKey) -> VerificationRunBuilder:
        self._key = key
        return self

    def run(self) -> Verified:
        declared = [(check, constraint) for check in self._checks for constraint in check.constraints]
        evaluation = evaluate(self._df, [m for _, constraint in declared for m in constraint.needed()])
        save(evaluation, self._repository, self._key)
        texts = {
            i: (constraint.assertion, evaluation.value(constraint.metric))
            for i, (_, constraint) in enumerate(declared)
            if isinstance(constraint.assertion, str)
        }
        by_text = _text_outcomes(self._spark, texts)
        outcomes = []
        for i, (check, constraint) in enumerate(declared):
            passed, message = _outcome(evaluation, constraint, by_text.get(i))
            outcomes.append((check, constraint, passed, message))
        return Verified(evaluation, outcomes)


def _text_outcomes(
    spark: SparkSession, texts: dict[int, tuple[str, float | None]]
) -> dict[int, bool | PySparkException | None]:
    """Evaluate SQL conditions over ``value``: together, or singly when one of them is faulty."""
    if not texts:
        return {}
    outcome = F.lit(None).cast("boolean")
    for i, (text, _) in texts.items():
        outcome = F.when(F.col("place") == i, F.expr(text)).otherwise(outcome)
    values = small_frame(spark, [(i, value) for i, (_, value) in texts.items()], "place int, value double")
    try:
        return dict(map(tuple, values.select("place", outcome).collect()))
    except PySparkException as error:
        if len(texts) == 1:
            return dict.fromkeys(texts, error)
        return {i: one[i] for i in texts for one in [_text_outcomes(spark, {i: texts[i]})]}


def _outcome(
    evaluation: Evaluation, constraint: Constraint, by_text: bool | PySparkException | None
) -> tuple[bool, str]:
    hint = f": {constraint.hint}" if constraint.hint else ""
    for metric in constraint.needed():
        failure = evaluation.failure(metric)
        if failure is not None:
            return False, f"{failure.error}, {failure.message}{hint}"
    value = evaluation.value(constraint.metric)
    shown = f"value {value}"
    try:
        if isinstance(by_text, PySparkException):
            return False, f"the assertion raised {by_text.getCondition()}{hint}"
        if isinstance(constraint.assertion, str):
            passed = bool(by_text)
        elif isinstance(constraint.assertion, Against):
            bounds = [evaluation.value(metric) for metric in constraint.assertion.metrics]
            shown = f"value {value} against {', '.join(map(str, bounds))}"
            passed = bool(constraint.assertion.predicate(value, *bounds))
        elif isinstance(constraint.assertion, OfType):
            counts = evaluation.parts(constraint.metric, "DataType.abs.")
            shown = f"types {counts}"
            passed = constraint.assertion(counts)
        else:
            passed = bool(constraint.assertion(value))
    except Exception as error:  # an assertion is user code
        return False, f"the assertion raised {type(error).__name__}{hint}"
    return passed, "" if passed else f"{shown} does not meet the constraint{hint}"


class VerificationResult:
    """Views of a verification result."""

    @staticmethod
    def checkResultsAsDataFrame(spark: SparkSession, result: Verified) -> DataFrame:
        return small_frame(spark, result.rows(), RESULT_SCHEMA)

    @staticmethod
    def successMetricsAsDataFrame(spark: SparkSession, result: Verified) -> DataFrame:
        return result.evaluation.success_frame()

    @staticmethod
    def addUpdateRepository(
        spark: SparkSession, tag_value: str, df_metrics: DataFrame, target: MetricTarget
    ) -> DataFrame:
        return stamp_and_append(df_metrics, target, tag_value)

"""Data-quality metrics, checks and suggestions on Spark tables."""

from plumbline.operators.metrics import (
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    ContainedIn,
    ContainedInTable,
    Correlation,
    CountDistinct,
    DataType,
    Distinctness,
    Entropy,
    Histogram,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MinLength,
    MutualInformation,
    PatternMatch,
    Size,
    StandardDeviation,
    Sum,
    Uniqueness,
    UniqueValueRatio,
)
from plumbline.plans.analysis import AnalysisRunner, AnalyzerContext
from plumbline.plans.checks import Against, Check, CheckLevel, close_to
from plumbline.plans.suggestions import DEFAULT, ConstraintSuggestionRunner
from plumbline.plans.verification import VerificationResult, VerificationSuite
from plumbline.sources.frames import value_set
from plumbline.sources.history import FileSystemMetricsRepository, ResultKey
from plumbline.streaming.ranges import RangeStates
from plumbline.streaming.states import StateStore



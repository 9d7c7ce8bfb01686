"""Finding out, before anything runs, which metrics a table cannot provide."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import find_field
from plumbline.operators.metrics import Metric

TEXT = (T.StringType, T.CharType, T.VarcharType)


def _groupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _groupable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_groupable(field.dataType) for field in data_type)
    return not isinstance(data_type, (T.MapType, T.VariantType))


SUITS = {
    "any": lambda data_type: True,
    "groupable": _groupable,
    "numeric": lambda data_type: isinstance(data_type, T.NumericType),
    "text": lambda data_type: isinstance(data_type, TEXT),
}


Fault = tuple[str, str]


class Validator:
    """Finds ``(kind, explanation)`` of what keeps a metric from being computed on a table."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._conditions: dict[str, Fault | None] = {}
        exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
        names = [name if exact else name.lower() for name in df.columns]
        self._doubled = {name.lower() for name in names if names.count(name) > 1}

    def fault_of(self, metric: Metric) -> Fault | None:
        wrong = metric.fault()
        if wrong:
            return "IllegalParameter", wrong
        for name in metric.columns:
            field = find_field(self._df.schema, name)
            if field is None:
                return "MissingColumn", f"no column named {name!r}"
            if name.lower() in self._doubled:
                return "AmbiguousColumn", f"several columns named {name!r}"
            if not SUITS[metric.needs](field.dataType):
                kind = field.dataType.simpleString()
                return "WrongType", f"column {name!r} is {kind}, not {metric.needs}"
        for text in metric.conditions:
            if text not in self._conditions:
                self._conditions[text] = self._condition_fault(text)
            if self._conditions[text]:
                return self._conditions[text]
        if metric.pattern_text is not None and not _compiles(self._df, metric.pattern_text):
            return "IllegalParameter", f"not a regular expression: {metric.pattern_text!r}"
        return None

    def _condition_fault(self, text: str) -> Fault | None:
        """Analysis finds unknown names and wrong types; bad values show only in a run."""
        try:
            found = self._df.filter(F.expr(text)).select(F.expr(text)).schema[0].dataType
        except PySparkException as error:
            return "InvalidPredicate", f"{text!r}: {error.getCondition()}"
        if not isinstance(found, T.BooleanType):
            return "InvalidPredicate", f"{text!r} is {found.simpleString()}, not boolean"
        return None


def _compiles(df: DataFrame, pattern: str) -> bool:
    """Try the pattern on one constant; the optimizer folds this, so no task runs."""
    try:
        df.sparkSession.sql("SELECT '' RLIKE :pattern", {"pattern": pattern}).collect()
    except (PySparkException, Py4JError):
        return False
    return True


def is_data_fault(error: Exception) -> bool:
    """Whether a job failed on a value (SQLSTATE class 22), not on the cluster."""
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    return bool(state) and state.startswith("22")

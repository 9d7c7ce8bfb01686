"""Inputs from files, from pandas, and columns used as value sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.functions.columns import find_field, quoted
from plumbline.operators.rows import small_frame


def as_spark_frame(spark: SparkSession, df) -> DataFrame:
    """A Spark frame as it is; a pandas frame, already whole on the driver, is handed over."""
    return df if isinstance(df, DataFrame) else spark.createDataFrame(df)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = False,
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """A CSV file with a header: by ``schema``, else inferred in an extra pass, else all text."""
    reader = spark.read.format("csv").option("header", True).option("sep", ",")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    return reader.options(**(options or {})).load(path)


def value_set(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, as a frame to join with."""
    return df.select(quoted(find_field(df.schema, column).name)).distinct()


def schema_frame(df: DataFrame) -> DataFrame:
    """The schema as rows ``(position, column, type)``."""
    rows = [(i, field.name, field.dataType.simpleString()) for i, field in enumerate(df.schema)]
    return small_frame(df.sparkSession, rows, "position int, column string, type string")

"""Addressing columns by user-given names, and typed casts of text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column whose name may hold blanks, dots, parentheses or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_field(schema: T.StructType, name: str) -> T.StructField | None:
    """The field ``name`` addresses: an exact match, else one that differs in case only."""
    folded = [field for field in schema.fields if field.name.lower() == name.lower()]
    exact = [field for field in folded if field.name == name]
    return (exact or folded or [None])[0]


def cast_columns(df: DataFrame, types: Mapping[str, T.DataType | str]) -> DataFrame:
    """Cast the named columns in one projection; a value that does not fit becomes NULL."""
    targets = {}
    for name, target in types.items():
        field = find_field(df.schema, name)
        if field is None:
            raise ValueError(f"no column named {name!r}")
        targets[field.name] = target
    return df.select(
        *[
            quoted(name).try_cast(targets[name]).alias(name) if name in targets else quoted(name)
            for name in df.columns
        ]
    )


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def as_text(value: Column, data_type: T.DataType) -> Column:
    """A text form that differs whenever the values differ."""
    return F.hex(value) if isinstance(data_type, T.BinaryType) else value.cast("string")

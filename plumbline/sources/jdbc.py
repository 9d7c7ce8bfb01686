"""Tables behind JDBC.  Options are a plain mapping, never printed or logged."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcTable:
    """A table named by reader options; ``with_table`` gives another one of the same database."""

    options: Mapping[str, object] = field(repr=False)

    def with_options(self, **changed: object) -> JdbcTable:
        return JdbcTable({**self.options, **changed})

    def with_table(self, table: str) -> JdbcTable:
        return self.with_options(dbtable=table)

    def partitioned(self, column: str, lower: object, upper: object, partitions: int) -> JdbcTable:
        """Read a large table by parallel range queries on ``column``."""
        return self.with_options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options).load()

    def append(self, df: DataFrame, column_types: str | None = None) -> None:
        """Append, creating the table first if it is absent, with ``column_types`` if given."""
        extra = {"createTableColumnTypes": column_types} if column_types else {}
        df.write.format("jdbc").options(**{**self.options, **extra}).mode("append").save()

"""The flat metric table: metrics with a tag and the time they were appended."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.jdbc import JdbcTable

STAMPED_SCHEMA = (
    "entity string, instance string, name string, value double, tag string, timestamp timestamp, run string"
)
# An instance may list the values that a column may have.
JDBC_TYPES = (
    "entity VARCHAR(255), instance VARCHAR(4000), name VARCHAR(4000), "
    "value DOUBLE PRECISION, tag VARCHAR(255), timestamp VARCHAR(255)"
)


def stamp(df_metrics: DataFrame, tag: str, at: datetime | None = None, run: str | None = None) -> DataFrame:
    """Add a tag, the time, and the name of the run, all fixed now however often the frame is used."""
    at = at or datetime.now(UTC)
    return df_metrics.withColumns(
        {"tag": F.lit(tag), "timestamp": F.lit(at), "run": F.lit(run or uuid.uuid4().hex)}
    )


def with_text_time(stamped: DataFrame) -> DataFrame:
    return stamped.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


class MetricTarget(Protocol):
    """Where stamped metrics go."""

    def append(self, stamped: DataFrame) -> None: ...


@dataclass(frozen=True)
class MetricTable:
    """A catalog table, created on first use."""

    spark: SparkSession
    table: str
    location: str | None = None

    def create(self) -> None:
        place = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({STAMPED_SCHEMA}) USING parquet{place}")

    def append(self, stamped: DataFrame) -> None:
        """Append the metrics that the table does not hold yet of a run and tag, so that a repeated append adds nothing.

        Further metrics of a run, of a second analysis say or under another tag, are added to the first.
        """
        self.create()
        columns = [column.split()[0] for column in STAMPED_SCHEMA.split(", ")]
        identity = ["run", "tag", "entity", "instance", "name"]
        known = self.read().select(*identity).distinct()
        stamped.select(*columns).join(known, identity, "left_anti").select(*columns).write.insertInto(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)


@dataclass(frozen=True)
class JdbcMetricTable:
    """A JDBC table, which the first append creates; it holds the time as text."""

    table: JdbcTable

    def append(self, stamped: DataFrame) -> None:
        self.table.append(with_text_time(stamped).drop("run"), JDBC_TYPES)


def stamp_and_append(
    df_metrics: DataFrame, target: MetricTarget, tag: str, at: datetime | None = None, run: str | None = None
) -> DataFrame:
    """Stamp metrics, append them, and return the stamped frame; a caller that retries gives its ``run``."""
    stamped = stamp(df_metrics, tag, at, run)
    target.append(stamped)
    return stamped

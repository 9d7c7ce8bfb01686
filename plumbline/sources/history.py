"""Metric history: every saved run under a key, read back as a table.

Saving only adds files, and a commit names them: what was written by a run that died before its commit does
not count, and a reader sees the commits up to one version, whatever others save or compact meanwhile.  Reading keeps,
for each metric under each key, the value of the last commit,
so a metric saved again replaces its former value and new metrics add to the key.  The latest
value is taken by an aggregate, which combines on the map side and sorts nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.streaming.log import VERSION, CommitLog

MILLIS_PER_DAY = 24 * 60 * 60 * 1000
# ``metric`` tells apart what entity, instance and name may share: other parameters, other predicates.
IDENTITY = ["dataset_date", "tags_key", "metric", "filter", "entity", "instance", "name"]
HISTORY_SCHEMA = (
    "dataset_date bigint, tags map<string,string>, tags_key string, metric string, filter string, "
    "entity string, instance string, name string, value double, run string, written_at bigint, committed bigint, "
    "dataset_day bigint"
)
#: ``add`` and ``remove`` name the files of a batch for a day; ``expire`` the version that the oldest files left are of.
LOG_SCHEMA = "action string, batch string, dataset_day bigint, written_at bigint, horizon bigint"
#: Commits come one after the other, whatever the writers' clocks say; within one, the larger value of equal keys counts.
ORDER = ["committed", "written_at", "value"]
VIEW = ["entity", "instance", "name", "value", "filter", "dataset_date"]


@dataclass(frozen=True)
class ResultKey:
    """When a run took place, in epoch milliseconds, and its tags."""

    spark: SparkSession = field(repr=False, compare=False)
    dataset_date: int
    tags: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def current_milli_time() -> int:
        return time.time_ns() // 1_000_000


def tags_key(tags: Column) -> Column:
    """The tags as sorted JSON: maps can be neither compared nor grouped in every place."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


class MetricsRepository(Protocol):
    def save(self, key: ResultKey, metrics: DataFrame) -> int | None: ...

    def load(self) -> History: ...


class FileSystemMetricsRepository:
    """History in a folder of files, partitioned by the batch that wrote them and by day, and a log of commits.

    Saves, compactions and reads may go on side by side, from as many drivers as there are.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self._spark = spark
        self.path = path
        self._rows = f"{path.rstrip('/')}/rows"
        self._log = CommitLog(spark, f"{path.rstrip('/')}/log", LOG_SCHEMA)
        self._format = format

    def version(self) -> int:
        """The number of the last commit, to read at later on."""
        return self._log.version()

    def version_at(self, millis: int) -> int:
        """The version that was the last at an instant: the one before the first commit begun after it."""
        later = self._log.read().where(F.col("written_at") > millis * 1_000_000 + 999_999)
        first = later.agg(F.min(VERSION)).first()[0]
        return self.version() if first is None else first - 1

    def save(self, key: ResultKey, metrics: DataFrame) -> int:
        """Add ``metrics`` (entity, instance, name, value and possibly filter and metric) under ``key``; the version."""
        pairs = [F.lit(text) for item in sorted(key.tags.items()) for text in item]
        tags = F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), "map<string,string>")
        return self.save_keyed(metrics.withColumns({"dataset_date": F.lit(key.dataset_date), "tags": tags}))

    def save_keyed(self, metrics: DataFrame) -> int:
        """Add metrics that carry their own ``dataset_date`` and ``tags``; the version."""
        for name in {"filter", "metric"} - set(metrics.columns):
            metrics = metrics.withColumn(name, F.lit(None).cast("string"))
        batch = uuid.uuid4().hex
        rows = metrics.withColumns(
            {
                "dataset_date": F.col("dataset_date").cast("bigint"),
                "tags_key": tags_key(F.col("tags")),
                "run": F.lit(batch),
                "written_at": F.lit(time.time_ns()),
                "committed": F.lit(None).cast("bigint"),
                "dataset_day": F.expr(f"cast(floor(dataset_date / {MILLIS_PER_DAY}) AS bigint)"),
            }
        )
        self._write(rows, batch)
        return self._log.commit(self._entries(self._days(batch), "add"))

    def compact(self, before: int) -> int:
        """Put the files of each day that ended by ``before`` (epoch milliseconds) together, with the last values only.

        What is saved under keys of those days meanwhile stays beside the new files, and versions before this one are
        read from the old files.  Of two compactions of the same files the second is refused.
        """
        at = self.version()
        log = self._log.read(at)
        closed = live_files(log).where(F.col("dataset_day") < before // MILLIS_PER_DAY)
        many = closed.groupBy("dataset_day").agg(F.count("*").alias("files")).where("files > 1")
        replaced = closed.join(many, "dataset_day", "left_semi")
        if replaced.isEmpty():
            return at
        rows = self._read(log, replaced, at)
        last = F.max_by(F.struct("value", "run", "written_at", "committed"), F.struct(*ORDER)).alias("last")
        kept = rows.groupBy(*IDENTITY, "dataset_day").agg(last)
        kept = kept.withColumn("tags", F.from_json("tags_key", "map<string,string>")).select("*", "last.*")
        batch = uuid.uuid4().hex
        self._write(kept, batch)
        removed = self._entries(replaced, "remove")

        def check(last: int) -> None:
            gone = self._log.read(last).where((F.col(VERSION) > at) & (F.col("action") == "remove"))
            if not gone.join(removed, ["batch", "dataset_day"], "left_semi").isEmpty():
                raise ValueError("another compaction has put some of the files together meanwhile")

        return self._log.commit(self._entries(self._days(batch), "add").unionByName(removed), check)

    def expire(self, at: int) -> int:
        """Delete files that no version from ``at`` on reads; earlier versions are refused from then on.

        Frames of earlier versions that are loaded already may fail.  Run again, it deletes what a lost run has left.
        """
        log = self._log.read()
        if at > self.version():
            raise ValueError(f"there is no version {at} yet")
        horizon = self._entries(self._spark.range(1).select(F.lit(None).cast("string").alias("batch")), "expire", at)
        done = self._log.commit(horizon)
        files = self._spark._jvm.org.apache.hadoop.fs
        for row in log.where((F.col("action") == "remove") & (F.col(VERSION) <= at)).toLocalIterator():
            folder = files.Path(f"{self._rows}/batch={row.batch}/dataset_day={row.dataset_day}")
            folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)
        return done

    def load(self, at: int | None = None) -> History:
        """The history at the version ``at``, or the last now; ``ValueError`` if files of that version have expired."""
        last = self.version()
        log, at = self._log.read(last), last if at is None else at
        return History(self._read(log, live_files(log.where(F.col(VERSION) <= at)), at))

    def _write(self, rows: DataFrame, batch: str) -> None:
        names = [column.split()[0] for column in HISTORY_SCHEMA.split(", ")]
        kept = rows.select(*names).hint("rebalance", "dataset_day")
        kept.write.format(self._format).partitionBy("dataset_day").save(f"{self._rows}/batch={batch}")

    def _days(self, batch: str) -> DataFrame:
        """The files of a batch, by day, as its folders name them."""
        files = self._spark._jvm.org.apache.hadoop.fs
        folder = files.Path(f"{self._rows}/batch={batch}")
        found = folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).listStatus(folder)
        days = [one.getPath().getName().partition("=")[2] for one in found if one.isDirectory()]
        rows = [(batch, int(day) if day.lstrip("-").isdigit() else None) for day in days if day]
        return self._spark.createDataFrame(rows, "batch string, dataset_day bigint")

    def _entries(self, files: DataFrame, action: str, horizon: int | None = None) -> DataFrame:
        day = F.col("dataset_day") if "dataset_day" in files.columns else F.lit(None)
        return files.select(
            F.lit(action).alias("action"),
            "batch",
            day.cast("bigint").alias("dataset_day"),
            F.lit(time.time_ns()).alias("written_at"),
            F.lit(horizon).cast("bigint").alias("horizon"),
        )

    def _read(self, log: DataFrame, files: DataFrame, at: int) -> DataFrame:
        """The rows of some files.  Only folders of their batches are listed: one for each commit not yet compacted."""
        horizon = log.where("action = 'expire'").select("batch", "horizon")
        found = files.select("batch", F.lit(None).cast("bigint").alias("horizon")).unionByName(horizon)
        rows = found.groupBy("batch").agg(F.max("horizon").alias("horizon")).collect()
        oldest = max((row.horizon for row in rows if row.horizon is not None), default=0)
        if at < oldest:
            raise ValueError(f"versions before {oldest} have expired")
        batches = [row.batch for row in rows if row.batch is not None]
        if not batches:
            return self._spark.createDataFrame([], HISTORY_SCHEMA)
        reader = self._spark.read.format(self._format).schema(f"{HISTORY_SCHEMA}, batch string")
        rows = reader.option("basePath", self._rows).load([f"{self._rows}/batch={batch}" for batch in batches])
        named = files.select(F.col("batch").alias("file_batch"), F.col("dataset_day").alias("file_day"), VERSION)
        same = (F.col("batch") == F.col("file_batch")) & F.col("dataset_day").eqNullSafe(F.col("file_day"))
        rows = rows.join(named, same).withColumn("committed", F.coalesce("committed", VERSION))
        return rows.drop("batch", "file_batch", "file_day", VERSION)


def live_files(log: DataFrame) -> DataFrame:
    """``(batch, dataset_day, version)`` of the files that count at the end of ``log``, and when they were committed."""
    files = log.where("action IN ('add', 'remove')").groupBy("batch", "dataset_day")
    ends = files.agg(F.min(VERSION).alias(VERSION), F.bool_or(F.col("action") == "remove").alias("removed"))
    return ends.where("NOT removed").drop("removed")


@dataclass(frozen=True)
class History:
    rows: DataFrame

    def before(self, millis: int) -> History:
        """Runs up to and including an instant; files of later days are not read."""
        day = millis // MILLIS_PER_DAY
        return History(self.rows.filter((F.col("dataset_day") <= day) & (F.col("dataset_date") <= millis)))

    def latest(self) -> DataFrame:
        last = self.rows.groupBy(*IDENTITY).agg(F.max_by("value", F.struct(*ORDER)).alias("value"))
        return last.withColumn("tags", F.from_json("tags_key", "map<string,string>"))

    def getSuccessMetricsAsDataFrame(self, withTags: Sequence[str] | None = None) -> DataFrame:
        """Metrics with their ``filter``, ``dataset_date`` and a column per tag asked for, or else all ``tags`` as a map.

        A tag named as one of the other columns gets ``tag_`` before its name.
        """
        if withTags is None:
            return self.latest().select(*VIEW, "tags")
        named = [F.col("tags")[tag].alias(f"tag_{tag}" if tag.lower() in VIEW else tag) for tag in withTags]
        return self.latest().select(*VIEW, *named)

"""A log of commits in a folder: writers beside each other, and readers who see one version of all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


class CommitLog:
    """Rows of commits, each commit a folder named by its version.

    A commit is written aside and takes the next version by a rename, which fails if another writer has taken it; then
    the next one is tried.  What a writer leaves that dies before its rename is never read.  Commits are small: they name
    what was written elsewhere, under names that no one else uses.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self._spark, self._path, self._schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self._path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version there is, 0 before the first commit."""
        folder = self._hadoop.Path(self._path)
        if not self._files.exists(folder):
            return 0
        names = [one.getPath().getName() for one in self._files.listStatus(folder)]
        return max((int(name.partition("=")[2]) for name in names if name.startswith(f"{VERSION}=")), default=0)

    def commit(self, rows: DataFrame, check: Callable[[int], None] | None = None) -> int:
        """Add the rows as one version, and return it; ``check`` may refuse it, given the version that it would follow."""
        aside = f"{self._path}/_aside-{uuid.uuid4().hex}"
        columns = [column.split()[0] for column in self._schema.split(", ")]
        rows.select(*columns).coalesce(1).write.parquet(aside)
        while True:
            last = self.version()
            if check:
                check(last)
            if self._take(aside, f"{self._path}/{VERSION}={last + 1:012d}"):
                return last + 1

    def _take(self, source: str, target: str) -> bool:
        """Rename a folder, which is not empty, to a name that must be free."""
        source, target = self._hadoop.Path(source), self._hadoop.Path(target)
        try:
            if self._files.getUri().getScheme() == "file":
                self._move(source, target)
            else:
                options = self._spark._jvm.org.apache.hadoop.fs.Options.Rename
                no_options = self._spark.sparkContext._gateway.new_array(options, 0)
                context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._spark._jsc.hadoopConfiguration())
                context.rename(source, target, no_options)
        except Exception:
            if self._files.exists(target):
                return False
            raise
        return True

    def _move(self, source: JavaObject, target: JavaObject) -> None:
        """The system's own rename, which refuses a folder that holds files; Hadoop's looks first and then copies into it."""
        nio, file = self._spark._jvm.java.nio.file, self._spark._jvm.java.io.File
        options = self._spark.sparkContext._gateway.new_array(nio.CopyOption, 1)
        options[0] = nio.StandardCopyOption.ATOMIC_MOVE
        paths = [file(path.toUri().getPath()).toPath() for path in (source, target)]
        nio.Files.move(*paths, options)

    def read(self, at: int | None = None) -> DataFrame:
        """The rows of all commits up to the version ``at``, or the last now; later ones are not met however late it runs."""
        at = self.version() if at is None else at
        schema = f"{self._schema}, {VERSION} long"
        if not at:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(self._path).where(F.col(VERSION) <= at)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of files, or an empty one if there are none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

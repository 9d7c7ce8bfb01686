"""Mergeable metric states: metrics of all data from stored states of its parts.

A part is a day, a partition, a micro-batch: whatever is computed once and seldom again.
Saving a metric of a part replaces its state, so a retried or repeated save changes nothing, and other
metrics of the part stay.  Three tables hold them: one row per part and scan metric, the value
counts of each column set per part, which are merged by summing, and for exact quantiles the sorted values of a column
per part (``streaming/runs.py``).  A ledger says which rows count, so that saving,
rolling up and reading may go on side by side.  Reading checks that every part
has a state of every metric asked for, and fails if one lacks: totals over some parts are never
given for all.  Old parts can be rolled up into one.

Means and second moments merge about the overall mean, ``M2 = sum(M2_i + n_i (mean_i -
mean)^2)``, because differences of sums of squares lose digits.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, find_field, quoted
from plumbline.operators import metrics as M
from plumbline.operators.frequency import (
    COUNT,
    bin_rows,
    resolved,
    rows_of_counts,
    sharing_counts,
    value_counts,
)
from plumbline.operators.rows import Placed, aggregate_rows, local_rows
from plumbline.operators.validation import Validator
from plumbline.plans.evaluation import METRIC_COLUMNS
from plumbline.streaming.log import CommitLog, stored
from plumbline.streaming.runs import HEAD_SCHEMA, RUN_SCHEMA, SLOT_VALUES, heads_of, in_slots, quantile_values, run_counts

TYPE_COUNTS = [kind.lower() for kind in M.DataType.CLASSES]
SUMMED = ["n", "hits", *TYPE_COUNTS]
MOMENTS = ["mean_x", "m2_x", "mean_y", "m2_y", "c_xy"]
FIELDS = {
    **dict.fromkeys(SUMMED, "bigint"),
    **dict.fromkeys(["total", "low", "high", *MOMENTS], "double"),
    **dict.fromkeys(["distinct_sketch", "rank_sketch"], "binary"),
}
SCAN_SCHEMA = ", ".join(
    [
        "metric string",
        *[f"{name} {kind}" for name, kind in FIELDS.items()],
        "metric_id string, part string",
    ]
)
COUNTS_SCHEMA = "keys array<string>, count bigint, column_set string, part string"
#: ``save`` and ``roll`` say which batch holds a state, ``cover`` which state of a part a roll-up was made of.
LEDGER_SCHEMA = "action string, id string, part string, batch string, name string"
LARGEST_RANK_SKETCH, LARGEST_DISTINCT_SKETCH = 65_535, 21


def has_state(metric: M.Metric) -> bool:
    """Comparisons with a table have none: the table may have changed since."""
    return metric.family in ("scan", "frequency", "selection")


def _moments(x: Column, y: Column | None = None) -> dict[str, Column]:
    n = F.count(x)
    state = {"n": n, "mean_x": F.avg(x), "m2_x": F.var_pop(x) * n}
    if y is not None:
        state |= {"mean_y": F.avg(y), "m2_y": F.var_pop(y) * n, "c_xy": F.covar_pop(x, y) * n}
    return state


def _sketch_size(relative_error: float) -> int:
    """Size parameter of a KLL sketch whose rank error stays within ``relative_error``."""
    return max(200, math.ceil((2.296 / relative_error) ** (1 / 0.9723)))


def _register_bits(deviation: float) -> int:
    """Logarithm of the registers of a HyperLogLog sketch whose unions deviate by no more than ``deviation``."""
    return max(4, math.ceil(2 * math.log2(1.04 / deviation)))


def state_of(metric: M.Metric, scope: M.Scope) -> dict[str, Column]:
    """The aggregates that make up a metric's state over one part."""
    numbers = []
    if metric.needs == "numeric":
        numbers = [scope.kept(scope.column(name).cast("double")) for name in metric.columns]
    match metric:
        case M.Size():
            return {"n": scope.rows}
        case M.Share():
            return {"n": scope.rows, "hits": scope.count_if(metric.holds(scope))}
        case M.Minimum() | M.MinLength():
            return {"low": metric.value(scope).cast("double")}
        case M.Maximum() | M.MaxLength():
            return {"high": metric.value(scope).cast("double")}
        case M.Sum():
            return {"total": metric.value(scope)}
        case M.Mean() | M.StandardDeviation():
            return _moments(*numbers)
        case M.Correlation():
            x, y = numbers
            return _moments(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
        case M.DataType():
            return {"n": scope.rows, **dict(zip(TYPE_COUNTS, metric.counts(scope)))}
        case M.ApproxCountDistinct():
            data_type = scope.field(metric.column).dataType
            value = as_text(scope.column(metric.column), data_type)
            return {"distinct_sketch": F.hll_sketch_agg(scope.kept(value), _register_bits(metric.relativeDeviation))}
        case M.ApproxQuantile() | M.ApproxQuantiles():
            size = _sketch_size(metric.relativeError)
            return {"rank_sketch": F.kll_sketch_agg_double(numbers[0], size)}
    raise ValueError(f"no mergeable state for {metric}")


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """One state per metric from the states of its parts, or one for each value of the columns ``by``."""
    n = F.sum("n")
    centre = states.groupBy("metric", *by).agg(
        F.try_divide(F.sum(F.col("n") * F.col("mean_x")), n).alias("centre_x"),
        F.try_divide(F.sum(F.col("n") * F.col("mean_y")), n).alias("centre_y"),
    )
    dx = F.col("mean_x") - F.col("centre_x")
    dy = F.col("mean_y") - F.col("centre_y")
    merged = {
        **{name: F.sum(name) for name in [*SUMMED, "total"]},
        "low": F.min("low"),
        "high": F.max("high"),
        "mean_x": F.first("centre_x"),
        "mean_y": F.first("centre_y"),
        "m2_x": F.sum(F.col("m2_x") + F.col("n") * dx * dx),
        "m2_y": F.sum(F.col("m2_y") + F.col("n") * dy * dy),
        "c_xy": F.sum(F.col("c_xy") + F.col("n") * dx * dy),
        "distinct_sketch": F.hll_union_agg("distinct_sketch", True),
        "rank_sketch": F.kll_merge_agg_double("rank_sketch"),
    }
    # Without further columns the centres are one row per requested metric, as long as the metric list.
    return (
        states.join(centre if by else F.broadcast(centre), ["metric", *by])
        .groupBy("metric", *by)
        .agg(*[value.alias(name) for name, value in merged.items()])
    )


def read_state(metric: M.Metric) -> M.Outputs:
    """The values of a metric from its merged state."""
    n = F.col("n")
    match metric:
        case M.Size():
            value = n
        case M.Share():
            value = F.try_divide("hits", n)
        case M.Minimum() | M.MinLength():
            value = F.col("low")
        case M.Maximum() | M.MaxLength():
            value = F.col("high")
        case M.Sum():
            value = F.col("total")
        case M.Mean():
            value = F.col("mean_x")
        case M.StandardDeviation():
            value = F.sqrt(F.try_divide("m2_x", n))
        case M.Correlation():
            value = F.try_divide(F.col("c_xy"), F.sqrt(F.col("m2_x") * F.col("m2_y")))
        case M.ApproxCountDistinct():
            value = F.hll_sketch_estimate("distinct_sketch")
        case M.DataType():
            kinds = list(zip(M.DataType.CLASSES, TYPE_COUNTS))
            return [(f"DataType.abs.{kind}", F.col(field)) for kind, field in kinds] + [
                (f"DataType.ratio.{kind}", F.try_divide(field, n)) for kind, field in kinds
            ]
        case M.ApproxQuantile() | M.ApproxQuantiles():
            filled = F.kll_sketch_get_n_double("rank_sketch") > 0
            return [
                (label, F.when(filled, F.kll_sketch_get_quantile_double("rank_sketch", F.lit(float(q)))))
                for label, q in zip(metric.labels(), metric.quantiles)
            ]
        case _:
            raise ValueError(f"no mergeable state for {metric}")
    return [(metric.name, value)]


def _short_hash(column: str) -> Column:
    return F.substring(F.sha2(F.col(column).cast("binary"), 256), 1, 32)


def state_id(like: DataFrame, metric: M.Metric) -> str:
    """The folder that a metric's states are in."""
    if metric.family == "frequency":
        return _column_set(resolved(like, metric), metric.where)
    if metric.family == "selection":
        return hashlib.sha256(repr(("run", resolved(like, metric), metric.where)).encode()).hexdigest()[:32]
    return hashlib.sha256(repr(metric).encode()).hexdigest()[:32]


def _column_set(df_columns: tuple[str, ...], where: str | None) -> str:
    """A folder name for the counts of a column set under a row condition."""
    return hashlib.sha256(repr((df_columns, where)).encode()).hexdigest()[:32]


class StateStore:
    """States under one folder that every executor can reach.

    Files are only ever added, each writer's under a batch of its own.  The ledger, a log of commits, says which batch
    holds the state of a metric (or the counts of a column set) for a part; the last commit counts.
    """

    def __init__(self, spark: SparkSession, path: str, slot_values: int = SLOT_VALUES):
        self._spark, self._slot_values = spark, slot_values
        self._scan_path = f"{path.rstrip('/')}/scan"
        self._counts_path = f"{path.rstrip('/')}/counts"
        self._runs_path = f"{path.rstrip('/')}/runs"
        self._heads_path = f"{path.rstrip('/')}/heads"
        self._ledger = CommitLog(spark, f"{path.rstrip('/')}/ledger", LEDGER_SCHEMA)

    def version(self) -> int:
        """The number of the last commit, to read at later on."""
        return self._ledger.version()

    def save(self, df: DataFrame, metrics: Sequence[M.Metric], part: str | Column) -> int:
        """Store states of ``df`` and return the version; ``part`` names it, or is a column that splits it into parts.

        A named part without rows is stored as such, and so replaces what it held before.  NULL is a part like others.
        """
        return self._ledger.commit(self._entries(self._write_states(df, metrics, part), "save"))

    def _write_states(self, df: DataFrame, metrics: Sequence[M.Metric], part: str | Column) -> str:
        """Store states as a batch that does not count yet."""
        self._check(df, metrics)
        batch = uuid.uuid4().hex
        scan = [metric for metric in dict.fromkeys(metrics) if metric.family == "scan"]
        if scan:
            self._write(scan_states(df, scan, part), self._scan_path, batch)
        sets = {
            (resolved(df, metric), metric.where): None for metric in metrics if metric.family == "frequency"
        }
        if sets:
            frames = [count_states(df, columns, where, part) for columns, where in sets]
            self._write(reduce(DataFrame.unionByName, frames), self._counts_path, batch)
        runs = {state_id(df, metric): metric for metric in metrics if metric.family == "selection"}
        if runs:
            of_part = F.lit(part) if isinstance(part, str) else part.cast("string")
            frames = [run_counts(df, one.columns[0], one.where, id_, of_part) for id_, one in runs.items()]
            there = parts_of(df, part).withColumn("run_id", F.explode(F.lit(list(runs))))
            self._write_runs(reduce(DataFrame.unionByName, frames), there, batch)
        return batch

    def metrics(
        self, like: DataFrame, metrics: Sequence[M.Metric], parts: Sequence[str | None] | None = None, at: int | None = None
    ) -> DataFrame:
        """Metrics over all parts, or some; ``like`` has the schema of the data, and is not read.

        All is read at one version of the ledger, ``at`` or the last, whatever others write meanwhile.  A
        ``ValueError`` names the metrics that some of the parts have no state of.
        """
        self._check(like, metrics)
        log = self._ledger.read(at)
        rolled = self._check_parts(like, metrics, log, parts)
        return self._values(like, metrics, live_states(log, parts, rolled))

    def _values(self, like: DataFrame, metrics: Sequence[M.Metric], live: DataFrame) -> DataFrame:
        placed = [Placed(i, metric) for i, metric in enumerate(dict.fromkeys(metrics))]
        frames = []
        scan = [one for one in placed if one.metric.family == "scan"]
        if scan:
            frames.append(scan_values(self._read(self._scan_path, SCAN_SCHEMA, live), scan))
        counted = [one for one in placed if one.metric.family == "frequency"]
        for (columns, where), group in sharing_counts(like, counted).items():
            of_set = live.where(F.col("id") == _column_set(columns, where))
            states = self._read(self._counts_path, COUNTS_SCHEMA, of_set).filter(F.col("count") > 0)
            frames += count_values(states, len(columns), group)
        selected = [one for one in placed if one.metric.family == "selection"]
        if selected:
            frames.append(self._quantiles(like, selected, live))
        values = reduce(DataFrame.unionByName, frames)
        return values.filter(F.col("value").isNotNull()).select(*METRIC_COLUMNS)

    def _quantiles(self, like: DataFrame, metrics: list[Placed], live: DataFrame) -> DataFrame:
        """Exact quantiles, found right away: only as many rows as there are quantiles are left."""
        runs = {one: state_id(like, one.metric) for one in metrics}
        live = live.where(F.col("id").isin(*runs.values()))
        heads = self._read(self._heads_path, HEAD_SCHEMA, live)
        wanted = [(runs[one], q) for one in metrics for q in one.metric.quantiles]
        found = quantile_values(heads, self._read(self._runs_path, RUN_SCHEMA, live), wanted)
        rows = [
            one.local_row(label, found.get((runs[one], q)))
            for one in metrics
            for label, q in zip(one.metric.labels(), one.metric.quantiles)
        ]
        return local_rows(self._spark, rows)

    def _check_parts(
        self, like: DataFrame, metrics: Sequence[M.Metric], log: DataFrame, parts: Sequence[str | None] | None
    ) -> bool:
        """Compare the parts that the ledger knows with those it has for each metric; whether any are rolled up."""
        of_parts = F.lit(True) if parts is None else among(parts)
        return self._check_held(like, metrics, log, of_parts, None if parts is None else len(set(parts)))

    def _check_held(
        self, like: DataFrame, metrics: Sequence[M.Metric], log: DataFrame, of_parts: Column, known: int | None = None
    ) -> bool:
        part = F.when((F.col("action") == "save") & of_parts, F.struct("part"))
        # A row of each metric, and one of all, in one pass.
        rows = log.rollup("id").agg(F.count_distinct(part).alias("parts"), F.max(F.col("action") == "cover").alias("rolled")).collect()
        found = {row["id"]: row["parts"] for row in rows}
        known = found.get(None, 0) if known is None else known
        lacking = [str(one) for one in metrics if found.get(state_id(like, one), 0) < known or not known]
        if lacking:
            raise ValueError(f"no state of every part ({known}): {', '.join(lacking)}")
        return any(row["rolled"] for row in rows)

    def roll_up(self, name: str, parts: Sequence[str | None]) -> int:
        """Merge the states of ``parts`` into one, which is read in their place, and return the version.

        Every metric that any of them has must be there for all.  The merged state counts as long as no
        part of it is saved again; from then on the parts themselves count.  Roll-ups may hold one another, but a part
        in two of which neither holds the other is refused, and so is a name that is there already.
        """
        parts = list(dict.fromkeys(parts))
        log = self._ledger.read()
        live = live_states(log, parts)
        held = {row["id"]: row["count"] for row in live.groupBy("id").count().collect()}
        if not held or min(held.values()) < len(parts):
            raise ValueError("some of the parts lack states that others have")
        batch = self._write_merged(live, lambda states: states.withColumn("part", F.lit(name)))
        covered = live.select(F.lit("cover").alias("action"), "id", "part", "batch", F.lit(name).alias("name"))
        entries = self._entries(batch, "roll").withColumn("name", F.lit(name)).unionByName(covered)

        def check(last: int) -> None:
            others = self._ledger.read(last).where("action = 'cover'").select("name", "part").distinct()
            own = others.where(among(parts)).groupBy("name").agg(F.count("*").alias("shared"))
            sizes = others.groupBy("name").agg(F.count("*").alias("size")).join(own, "name", "left")
            for row in sizes.collect():
                if row["name"] == name:
                    raise ValueError(f"a roll-up {name} is there already")
                if row["shared"] and row["shared"] not in (row["size"], len(parts)):
                    raise ValueError(f"the roll-up {row['name']} holds some of the parts and others")

        return self._ledger.commit(entries, check)

    def _write_merged(self, live: DataFrame, regroup: Callable[[DataFrame], DataFrame]) -> str:
        """Merge states into those of the parts that ``regroup`` gives them, as a batch that does not count yet.

        ``regroup`` may give a state to several parts.
        """
        batch = uuid.uuid4().hex
        scan = merge_states(regroup(self._read(self._scan_path, SCAN_SCHEMA, live)), "part")
        counts = regroup(self._read(self._counts_path, COUNTS_SCHEMA, live))
        counts = counts.groupBy("column_set", "keys", "part").agg(F.sum("count").alias("count"))
        self._write(scan.withColumn("metric_id", _short_hash("metric")), self._scan_path, batch)
        self._write(counts, self._counts_path, batch)
        there = regroup(self._read(self._heads_path, HEAD_SCHEMA, live).where("rows = 0")).select("run_id", "part").distinct()
        if not there.isEmpty():
            runs = regroup(self._read(self._runs_path, RUN_SCHEMA, live))
            self._write_runs(runs.groupBy("run_id", "part", "value").agg(F.sum("count").alias("count")), there, batch)
        return batch

    def _write_runs(self, counts: DataFrame, there: DataFrame, batch: str) -> None:
        """Runs in the order of their values, and their heads from what was written."""
        in_slots(counts, self._slot_values).write.parquet(f"{self._runs_path}/batch={batch}")
        written = stored(self._spark, f"{self._runs_path}/batch={batch}", RUN_SCHEMA)
        self._write(heads_of(written, there), self._heads_path, batch)

    def batch_writer(self, metrics: Sequence[M.Metric], stream: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each micro-batch is a part; a replay replaces it.

        ``stream`` names the run of the stream: the same as long as its checkpoint is, and another one for
        a new checkpoint, whose batches are numbered from 0 again.
        """

        def write(batch: DataFrame, batch_id: int) -> None:
            kept = batch.persist()
            try:
                self.save(kept, metrics, f"{stream}-{batch_id}")
            finally:
                kept.unpersist()

        return write

    def _check(self, df: DataFrame, metrics: Sequence[M.Metric]) -> None:
        validator = Validator(df)
        for metric in metrics:
            fault = validator.fault_of(metric)
            if fault or not has_state(metric):
                raise ValueError(f"{metric}: {': '.join(fault) if fault else 'no mergeable state'}")
            match metric:
                case _ if metric.family != "scan":
                    too_small = False
                case M.ApproxCountDistinct():
                    too_small = _register_bits(metric.relativeDeviation) > LARGEST_DISTINCT_SKETCH
                case M.ApproxQuantile() | M.ApproxQuantiles():
                    too_small = _sketch_size(metric.relativeError) > LARGEST_RANK_SKETCH
                case _:
                    too_small = False
            if too_small:
                raise ValueError(f"{metric}: no sketch is as exact as that")

    def _write(self, states: DataFrame, path: str, batch: str) -> None:
        states.hint("rebalance").write.parquet(f"{path}/batch={batch}")

    def _entries(self, batch: str, action: str) -> DataFrame:
        """Ledger rows for what a batch has written."""
        found = []
        tables = (
            (self._scan_path, SCAN_SCHEMA, "metric_id"),
            (self._counts_path, COUNTS_SCHEMA, "column_set"),
            (self._heads_path, HEAD_SCHEMA, "run_id"),
        )
        for path, schema, id_ in tables:
            written = stored(self._spark, f"{path}/batch={batch}", schema)
            found.append(written.select(F.col(id_).alias("id"), "part"))
        entries = reduce(DataFrame.unionByName, found).distinct()
        return entries.select(
            F.lit(action).alias("action"), "id", "part", F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("name")
        )

    def _read(self, path: str, schema: str, live: DataFrame) -> DataFrame:
        """The states that count: those of the batch that the ledger names for their part."""
        id_ = {self._scan_path: "metric_id", self._counts_path: "column_set"}.get(path, "run_id")
        states = stored(self._spark, path, f"{schema}, batch string")
        named = live.select(F.col("id").alias("live_id"), F.col("part").alias("live_part"), F.col("batch").alias("live_batch"))
        same = (F.col(id_) == F.col("live_id")) & F.col("part").eqNullSafe(F.col("live_part")) & (F.col("batch") == F.col("live_batch"))
        return states.join(named, same, "left_semi")


def among(parts: Sequence[str | None]) -> Column:
    """Whether a part is one of those asked for, of which NULL may be one."""
    named = F.col("part").isin(*[part for part in parts if part is not None])
    return F.coalesce(named, F.lit(False)) | (F.lit(None in parts) & F.col("part").isNull())


def live_states(log: DataFrame, parts: Sequence[str | None] | None = None, rolled: bool = True) -> DataFrame:
    """``(id, part, batch)`` of the states that count at the end of ``log``: of all parts, or of some by name.

    A part counts by its last save.  With all parts, one that is rolled up counts as the largest roll-up whose
    parts are all as they were when it was made; ``rolled`` says whether there is any.
    """
    last = F.max_by("batch", "version").alias("batch")
    saved = log.where("action = 'save'").groupBy("id", "part").agg(last)
    if parts is not None:
        return saved.where(among(parts))
    if not rolled:
        return saved
    covers = log.where("action = 'cover'").select("id", "part", "name", F.col("batch").alias("was"), "version")
    now = saved.select(F.col("id").alias("now_id"), F.col("part").alias("now_part"), F.col("batch").alias("now_batch"))
    same = (F.col("id") == F.col("now_id")) & F.col("part").eqNullSafe(F.col("now_part"))
    covers = covers.join(now, same).withColumn("as_was", F.col("was") == F.col("now_batch"))
    whole = covers.groupBy("id", "name").agg(F.every("as_was").alias("whole"), F.count("*").alias("size")).where("whole")
    # Of two roll-ups with a part in common one holds the other, so that the largest of each part agree.
    taken = covers.select("id", "part", "name").join(whole, ["id", "name"])
    taken = taken.groupBy("id", "part").agg(F.max_by("name", F.struct("size", "name")).alias("name"))
    merged = log.where("action = 'roll'").select("id", "part", "batch").join(taken.select("id", F.col("name").alias("part")), ["id", "part"], "left_semi")
    hidden = taken.select(F.col("id").alias("now_id"), F.col("part").alias("now_part"))
    return saved.join(hidden, same, "left_anti").unionByName(merged)


def scan_states(df: DataFrame, metrics: Sequence[M.Metric], part: str | Column) -> DataFrame:
    """All scan metrics of all parts in one pass, as one row per part and metric."""
    aggregates, rows = [], []
    scopes = {metric.where: M.Scope(df.schema, metric.where) for metric in metrics}
    for i, metric in enumerate(metrics):
        state = state_of(metric, scopes[metric.where])
        aggregates += [value.alias(f"s{i}_{name}") for name, value in state.items()]
        fields = ", ".join(
            f"'{name}', cast({f's{i}_{name}' if name in state else 'NULL'} AS {kind})"
            for name, kind in FIELDS.items()
        )
        rows.append(f"named_struct('metric', metrics[{i}], {fields})")
    ids = F.from_json(F.lit(json.dumps([repr(metric) for metric in metrics])), "array<string>")
    if isinstance(part, str):
        wide = df.agg(*aggregates).withColumn("part", F.lit(part))
    else:
        wide = df.groupBy(part.cast("string").alias("part")).agg(*aggregates)
    states = wide.withColumn("metrics", ids).selectExpr("part", f"inline(array({', '.join(rows)}))")
    return states.withColumn("metric_id", _short_hash("metric"))


def parts_of(df: DataFrame, part: str | Column) -> DataFrame:
    """The parts that a frame is saved as; one with a name is there without rows as well."""
    if isinstance(part, str):
        return df.sparkSession.range(1, numPartitions=1).select(F.lit(part).alias("part"))
    return df.select(part.cast("string").alias("part")).distinct()


def count_states(
    df: DataFrame, columns: tuple[str, ...], where: str | None, part: str | Column
) -> DataFrame:
    """Value counts of all parts, and for each part a row without counts, which says that it is there."""
    keys = [f"k{i}" for i in range(len(columns))]
    texts = [as_text(F.col(key), find_field(df.schema, name).dataType) for key, name in zip(keys, columns)]
    if isinstance(part, str):
        counts, of_part = value_counts(df, columns, where), F.lit(part)
    else:
        marked = df.withColumn("part of data", part.cast("string"))
        counts, of_part = value_counts(marked, (*columns, "part of data"), where), F.col(f"k{len(columns)}")
    of_set = F.lit(_column_set(columns, where)).alias("column_set")
    states = counts.select(
        F.array(*texts).alias("keys"), quoted(COUNT).alias("count"), of_set, of_part.alias("part")
    )
    nothing = parts_of(df, part).select(
        F.lit(None).cast("array<string>").alias("keys"), F.lit(0).cast("bigint").alias("count"), of_set, "part"
    )
    return states.unionByName(nothing)


def scan_values(states: DataFrame, metrics: list[Placed]) -> DataFrame:
    ids = [repr(one.metric) for one in metrics]
    merged = merge_states(states.filter(F.col("metric").isin(*ids)))
    outputs = []
    for one, key in zip(metrics, ids):
        is_it = F.col("metric") == key
        outputs += [(one, name, F.first(F.when(is_it, value), True)) for name, value in read_state(one.metric)]
    return aggregate_rows(merged, outputs)


def count_values(states: DataFrame, columns: int, metrics: list[Placed]) -> list[DataFrame]:
    keys = [F.col("keys")[i].alias(f"k{i}") for i in range(columns)]
    counts = states.groupBy(*keys).agg(F.sum("count").alias(COUNT))
    bins = [bin_rows(counts, F.col("k0"), one) for one in metrics if isinstance(one.metric, M.Histogram)]
    return rows_of_counts(counts, columns, metrics) + bins

"""Metric history, the stamped metric table, and inputs from files and pandas."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import cast_columns, rename_columns
from plumbline.gallery.base import ORDERS, Query, expected, rounded, table
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    Completeness,
    Compliance,
    Correlation,
    Distinctness,
    Maximum,
    Mean,
    Minimum,
    MutualInformation,
    Size,
    Sum,
)
from plumbline.plans.analysis import AnalysisRunner, AnalyzerContext
from plumbline.plans.checks import Check, CheckLevel
from plumbline.plans.verification import VerificationResult, VerificationSuite
from plumbline.session import scratch_folder
from plumbline.sources.frames import read_csv
from plumbline.sources.history import MILLIS_PER_DAY, FileSystemMetricsRepository, ResultKey
from plumbline.sources.stamped import MetricTable, with_text_time
from plumbline.sources.stamped import stamp_and_append as stamp_and_append_to

STAMPED_AT = datetime(2024, 5, 1, 12, 30, 0, 250_000, tzinfo=UTC)

DAY_MILLIS = f"datediff(cast(ts AS date), DATE '1970-01-01') * {MILLIS_PER_DAY}L"


def _daily(events: DataFrame, *metrics: str) -> DataFrame:
    """Metric rows of each day of events, keyed by the day."""
    asked = {
        "Size": F.count("*").cast("double"),
        "Mean": F.avg("value"),
        "Maximum": F.max("value"),
    }
    instances = {"Size": ("Dataset", "*"), "Mean": ("Column", "value"), "Maximum": ("Column", "value")}
    days = events.groupBy(F.expr(DAY_MILLIS).alias("dataset_date")).agg(
        *[asked[name].alias(name) for name in metrics]
    )
    rows = [
        F.struct(
            F.lit(instances[name][0]).alias("entity"),
            F.lit(instances[name][1]).alias("instance"),
            F.lit(name).alias("name"),
            F.col(name).alias("value"),
        )
        for name in metrics
    ]
    tags = F.create_map(F.lit("tag"), F.lit("daily"))
    return days.select("dataset_date", tags.alias("tags"), F.inline(F.array(*rows)))


def _repository(spark: SparkSession) -> FileSystemMetricsRepository:
    return FileSystemMetricsRepository(spark, scratch_folder(spark, "history"))


def history_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A second save under the same keys replaces some metrics and adds others."""
    events, repository = table(spark, folder, "events"), _repository(spark)
    repository.save_keyed(_daily(events.filter("event_type <> 'click'"), "Size", "Mean"))
    repository.save_keyed(_daily(events, "Size", "Maximum"))
    return rounded(repository.load().getSuccessMetricsAsDataFrame(["tag"]))


HISTORY_UPSERT = f"""
WITH e AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {MILLIS_PER_DAY} AS day FROM events),
     m AS (SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, day
           FROM e GROUP BY day
           UNION ALL SELECT 'Column', 'value', 'Mean', avg(value), day FROM e
           WHERE event_type <> 'click' GROUP BY day
           UNION ALL SELECT 'Column', 'value', 'Maximum', max(value), day FROM e GROUP BY day)
SELECT entity, instance, name, round(value, 6) AS value, NULL AS filter, CAST(day AS BIGINT) AS dataset_date, 'daily' AS tag
FROM m
"""


def history_before(spark: SparkSession, folder: str) -> DataFrame:
    """Only runs up to the middle of the time span, the day itself included."""
    events, repository = table(spark, folder, "events"), _repository(spark)
    repository.save_keyed(_daily(events, "Size", "Mean"))
    first, last = events.agg(
        F.min(F.expr(DAY_MILLIS)).alias("first"), F.max(F.expr(DAY_MILLIS)).alias("last")
    ).first()
    middle = (first + last) // 2
    return rounded(repository.load().before(middle).getSuccessMetricsAsDataFrame(["tag"]))


HISTORY_BEFORE = f"""
WITH e AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {MILLIS_PER_DAY} AS day FROM events),
     span AS (SELECT (min(day) + max(day)) // 2 AS middle FROM e),
     m AS (SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, day
           FROM e GROUP BY day
           UNION ALL SELECT 'Column', 'value', 'Mean', avg(value), day FROM e GROUP BY day)
SELECT entity, instance, name, round(value, 6) AS value, NULL AS filter, CAST(day AS BIGINT) AS dataset_date, 'daily' AS tag
FROM m, span WHERE day <= middle
"""


def history_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Each version of a history stays as it was, through later saves and compactions."""
    events, repository = table(spark, folder, "events"), _repository(spark)
    unclicked = events.filter("event_type <> 'click'")
    versions = [repository.save_keyed(_daily(unclicked, "Size", "Mean"))]
    held = repository.load()
    versions.append(repository.save_keyed(_daily(events, "Size", "Maximum")))
    versions.append(repository.compact(ResultKey.current_milli_time()))
    versions.append(repository.save_keyed(_daily(unclicked, "Size")))
    versions.append(repository.compact(ResultKey.current_milli_time()))
    frames = [(0, held)] + [(version, repository.load(version)) for version in versions]
    rows = [history.getSuccessMetricsAsDataFrame(["tag"]).withColumn("read_at", F.lit(at)) for at, history in frames]
    return rounded(reduce(DataFrame.unionByName, rows))


def _snapshot_sql() -> str:
    measured = """
        SELECT day, 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, {0} AS rows_of
        FROM e{1} GROUP BY day
        UNION ALL SELECT day, 'Column', 'value', 'Mean', avg(value), {0} FROM e{1} GROUP BY day
        UNION ALL SELECT day, 'Column', 'value', 'Maximum', max(value), {0} FROM e{1} GROUP BY day"""
    # What the reader of each version is to find: metric, and whether it is that of all rows (2) or of some (1).
    seen = {0: (("Size", 1), ("Mean", 1)), 1: (("Size", 1), ("Mean", 1))}
    seen |= dict.fromkeys((2, 3), (("Size", 2), ("Mean", 1), ("Maximum", 2)))
    seen |= dict.fromkeys((4, 5), (("Size", 1), ("Mean", 1), ("Maximum", 2)))
    wanted = ", ".join(f"({at}, '{name}', {kind})" for at, found in seen.items() for name, kind in found)
    return f"""
WITH e AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {MILLIS_PER_DAY} AS day FROM events),
     m AS ({measured.format(1, " WHERE event_type <> 'click'")} UNION ALL {measured.format(2, "")}),
     w(read_at, name, rows_of) AS (VALUES {wanted}),
     -- A day of clicks alone is not saved without them, so that its size stays that of all its rows.
     found AS (SELECT w.read_at, m.* FROM w JOIN m USING (name, rows_of)
               UNION ALL SELECT w.read_at, m.* FROM w JOIN m ON m.name = 'Size' AND m.rows_of = 2
               WHERE w.read_at > 3 AND w.name = 'Size' AND m.day NOT IN (SELECT day FROM m WHERE rows_of = 1))
SELECT entity, instance, name, round(value, 6) AS value, NULL AS filter, CAST(day AS BIGINT) AS dataset_date, 'daily' AS tag,
       read_at
FROM found
"""


def history_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """What was known at an instant of writing about the days up to another one; later corrections do not show."""
    events, repository = table(spark, folder, "events"), _repository(spark)
    unclicked = events.filter("event_type <> 'click'")
    repository.save_keyed(_daily(unclicked, "Size", "Mean"))
    repository.save_keyed(_daily(unclicked, "Size"))
    known = ResultKey.current_milli_time()
    time.sleep(0.01)
    repository.save_keyed(_daily(events, "Size", "Mean"))
    repository.compact(ResultKey.current_milli_time())
    first, last = events.agg(
        F.min(F.expr(DAY_MILLIS)).alias("first"), F.max(F.expr(DAY_MILLIS)).alias("last")
    ).first()
    history = repository.load(repository.version_at(known)).before((first + last) // 2)
    return rounded(history.getSuccessMetricsAsDataFrame(["tag"]))


HISTORY_AS_OF = f"""
WITH e AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {MILLIS_PER_DAY} AS day FROM events),
     span AS (SELECT (min(day) + max(day)) // 2 AS middle FROM e),
     m AS (SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, day
           FROM e WHERE event_type <> 'click' GROUP BY day
           UNION ALL SELECT 'Column', 'value', 'Mean', avg(value), day FROM e WHERE event_type <> 'click' GROUP BY day)
SELECT entity, instance, name, round(value, 6) AS value, NULL AS filter, CAST(day AS BIGINT) AS dataset_date, 'daily' AS tag
FROM m, span WHERE day <= middle
"""


def analysis_to_history(spark: SparkSession, folder: str) -> DataFrame:
    """An analysis and a verification, each saved under its key and tags, read back together."""
    orders, repository = ORDERS.frame(spark, folder), _repository(spark)
    analysis_key = ResultKey(spark, 1_700_000_000_000, {"tag": "analyzer"})
    check_key = ResultKey(spark, 1_700_000_100_000, {"tag": "gate", "by": "suite"})
    for metrics in ([Size()], [Mean("o_totalprice"), Completeness("priority"), Size()]):
        runner = AnalysisRunner(spark).onData(orders).addAnalyzers(metrics)
        runner.useRepository(repository).saveOrAppendResult(analysis_key).run()
    check = Check(spark, CheckLevel.Error, "orders arrive").hasSize("value > 0").isUnique("o_orderkey")
    suite = VerificationSuite(spark).onData(orders).addCheck(check)
    suite.useRepository(repository).saveOrAppendResult(check_key).run()
    history = repository.load().before(ResultKey.current_milli_time())
    return rounded(history.getSuccessMetricsAsDataFrame(["by", "tag"]))


ANALYSIS_TO_HISTORY = f"""
SELECT *, CASE WHEN tag = 'analyzer' THEN 1700000000000 ELSE 1700000100000 END AS dataset_date FROM (
  SELECT *, NULL AS filter, NULL AS by, 'analyzer' AS tag FROM ({
    expected(
        [
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
            ("Column", "o_totalprice", "Mean", "SELECT avg(o_totalprice) FROM orders"),
            ("Column", "priority", "Completeness", f"SELECT count(priority) / count(*) FROM {ORDERS.sql}"),
        ]
    )
})
  UNION ALL SELECT *, NULL, 'suite', 'gate' FROM ({
    expected(
        [
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
            (
                "Column",
                "o_orderkey",
                "Uniqueness",
                "SELECT count(*) FILTER (WHERE c = 1) / sum(c) "
                "FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)",
            ),
        ]
    )
}))
"""


def stamp_and_append(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of an analysis and of a verification in one stamped table; a repeated append adds nothing."""
    name = f"metrics_{uuid.uuid4().hex}"
    target = MetricTable(spark, name, scratch_folder(spark, "metrics"))
    orders = table(spark, folder, "orders")
    metrics = [Size(), Mean("o_totalprice"), ApproxCountDistinct("o_orderstatus")]
    result = AnalysisRunner(spark).onData(orders).addAnalyzers(metrics).run()
    found = AnalyzerContext.successMetricsAsDataFrame(spark, result)
    for _ in range(2):
        stamp_and_append_to(found, target, "analyzer", STAMPED_AT, "first run")
    check = Check(spark, CheckLevel.Warning, "orders are whole").isComplete("o_custkey")
    verified = VerificationSuite(spark).onData(orders).addCheck(check).run()
    found = VerificationResult.successMetricsAsDataFrame(spark, verified)
    stamp_and_append_to(found, target, "gate", STAMPED_AT, "second run")
    return rounded(with_text_time(target.read()))


STAMPED = f"""
SELECT *, 'analyzer' AS tag, '2024-05-01 12:30:00.250000' AS timestamp, 'first run' AS run FROM ({
    expected(
        [
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
            ("Column", "o_totalprice", "Mean", "SELECT avg(o_totalprice) FROM orders"),
            ("Column", "o_orderstatus", "ApproxCountDistinct", "SELECT count(DISTINCT o_orderstatus) FROM orders"),
        ]
    )
})
UNION ALL SELECT *, 'gate', '2024-05-01 12:30:00.250000', 'second run' FROM ({
    expected([("Column", "o_custkey", "Completeness", "SELECT count(o_custkey) / count(*) FROM orders")])
})
"""

# The customer table under headers with blanks, dots and parentheses.
HEADERS = {
    "c_custkey": "Member no. ",
    "c_name": "Name given",
    "c_nationkey": "Home (code).",
    "c_acctbal": "Balance due",
    "c_mktsegment": "Trade / branch",
}


def _customer_csv(spark: SparkSession, folder: str) -> str:
    path = scratch_folder(spark, "csv")
    customer = rename_columns(table(spark, folder, "customer"), HEADERS)
    customer.write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    return path


def csv_typed(spark: SparkSession, folder: str) -> DataFrame:
    """All columns read as text, then cast and renamed; names are no numbers and become NULL."""
    text = read_csv(spark, _customer_csv(spark, folder), ", ".join(f"`{h}` string" for h in HEADERS.values()))
    typed = cast_columns(
        text,
        {"Member no. ": "int", "Home (code).": "double", "balance DUE": "double", "Name given": "int"},
    )
    named = rename_columns(typed, {"Member no. ": "Member no", "Home (code).": "Home (code)"})
    metrics = [
        Size(),
        Completeness("Member no"),
        Completeness("Name given"),
        Mean("Home (code)"),
        Sum("Balance due"),
        Maximum("Member no"),
        Distinctness(["Home (code)", "trade / BRANCH"]),
        Compliance("well off", "`Balance due` >= 5000 AND `Home (code)` > 10"),
    ]
    return rounded(AnalysisRunner(spark).onData(named).addAnalyzers(metrics).asDataFrame(), 2)


CSV_TYPED = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM customer"),
        ("Column", "Member no", "Completeness", "SELECT count(c_custkey) / count(*) FROM customer"),
        ("Column", "Name given", "Completeness", "SELECT count(TRY_CAST(c_name AS INT)) / count(*) FROM customer"),
        ("Column", "Home (code)", "Mean", "SELECT avg(c_nationkey) FROM customer"),
        ("Column", "Balance due", "Sum", "SELECT sum(c_acctbal) FROM customer"),
        ("Column", "Member no", "Maximum", "SELECT max(c_custkey) FROM customer"),
        (
            "Multicolumn",
            "Home (code),trade / BRANCH",
            "Distinctness",
            "SELECT count(*) / sum(c) FROM "
            "(SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_mktsegment)",
        ),
        (
            "Column",
            "well off",
            "Compliance",
            "SELECT count(*) FILTER (WHERE c_acctbal >= 5000 AND c_nationkey > 10) / count(*) FROM customer",
        ),
    ],
    2,
)


def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    read = read_csv(spark, _customer_csv(spark, folder), infer=True)
    metrics = [
        Size(),
        Minimum("Balance due"),
        Correlation("Balance due", "Home (code)."),
        MutualInformation(["Home (code).", "Trade / branch"]),
    ]
    return rounded(AnalysisRunner(spark).onData(read).addAnalyzers(metrics).asDataFrame())


CSV_INFERRED = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM customer"),
        ("Column", "Balance due", "Minimum", "SELECT min(c_acctbal) FROM customer"),
        ("Multicolumn", "Balance due,Home (code).", "Correlation", "SELECT corr(c_acctbal, c_nationkey) FROM customer"),
        (
            "Multicolumn",
            "Home (code).,Trade / branch",
            "MutualInformation",
            "WITH ab AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS c FROM customer GROUP BY 1, 2), "
            "m AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY a) AS ca, "
            "sum(c) OVER (PARTITION BY b) AS cb FROM ab) SELECT sum(c / n * ln(c * n / (ca * cb))) FROM m",
        ),
    ]
)


def pandas_input(spark: SparkSession, folder: str) -> DataFrame:
    """A small pandas summary, one row per nation, analysed like any table."""
    summary = (
        table(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        .toPandas()
    )
    metrics = [Size(), Sum("customers"), Maximum("balance"), Completeness("c_nationkey")]
    return rounded(AnalysisRunner(spark).onData(summary).addAnalyzers(metrics).asDataFrame(), 2)


BY_NATION = "(SELECT c_nationkey, count(*) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1)"
PANDAS_INPUT = expected(
    [
        ("Dataset", "*", "Size", f"SELECT count(*) FROM {BY_NATION}"),
        ("Column", "customers", "Sum", f"SELECT sum(customers) FROM {BY_NATION}"),
        ("Column", "balance", "Maximum", f"SELECT max(balance) FROM {BY_NATION}"),
        ("Column", "c_nationkey", "Completeness", f"SELECT count(c_nationkey) / count(*) FROM {BY_NATION}"),
    ],
    2,
)

QUERIES = {
    "history_before": Query(history_before, HISTORY_BEFORE),
    "history_upsert": Query(history_upsert, HISTORY_UPSERT),
    "history_snapshot": Query(history_snapshot, _snapshot_sql()),
    "history_as_of": Query(history_as_of, HISTORY_AS_OF),
    "analysis_to_history": Query(analysis_to_history, ANALYSIS_TO_HISTORY),
    "stamp_and_append": Query(stamp_and_append, STAMPED),
    "csv_typed": Query(csv_typed, CSV_TYPED),
    "csv_inferred": Query(csv_inferred, CSV_INFERRED),
    "pandas_input": Query(pandas_input, PANDAS_INPUT),
}

"""Queries at the edges: nothing is cut off, nothing is dropped in silence, nothing is counted twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.gallery.base import ORDERS, Derived, Query, analysed, expected, rounded, table
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    ApproxQuantile,
    Completeness,
    Compliance,
    ContainedInTable,
    CountDistinct,
    Histogram,
    Maximum,
    Mean,
    Minimum,
    Size,
    Sum,
)
from plumbline.plans import suggestions as S
from plumbline.plans.analysis import AnalysisRunner
from plumbline.plans.checks import Check, CheckLevel
from plumbline.plans.verification import VerificationResult, VerificationSuite
from plumbline.session import scratch_folder
from plumbline.sources.frames import read_csv, schema_frame, value_set
from plumbline.sources.history import FileSystemMetricsRepository, ResultKey
from plumbline.sources.stamped import stamp, with_text_time
from plumbline.streaming.states import StateStore

EDGES = Derived(
    "lineitem",
    {
        "code99": "concat('c', cast(l_orderkey % 100 AS STRING))",
        "code100": "concat('c', cast(l_orderkey % 101 AS STRING))",
        "odd": "CASE WHEN l_orderkey % 7 = 0 THEN 'NullValue' WHEN l_orderkey % 7 <> 1 THEN l_returnflag END",
    },
)
TOTAL = "o_totalprice > 100000"


def histogram_all_bins(spark: SparkSession, folder: str) -> DataFrame:
    """All bins of a column of thousands of values; a text that reads as the bin of NULL is told from it."""
    frame = EDGES.frame(spark, folder)
    return analysed(frame, [Histogram("l_orderkey"), Histogram("odd")])


def _bins_sql() -> str:
    parts = []
    for column, name in (
        ("l_orderkey", "CAST(l_orderkey AS VARCHAR)"),
        ("odd", "CASE WHEN odd IS NULL THEN 'NullValue' WHEN odd = 'NullValue' THEN chr(92) || odd ELSE odd END"),
    ):
        f = f"(SELECT {name} AS v, count(*) AS c, sum(count(*)) OVER () AS n FROM {EDGES.sql} GROUP BY 1)"
        parts += [
            f"SELECT 'Column' AS entity, '{column}' AS instance, 'Histogram.bins' AS name, CAST(count(*) AS DOUBLE) AS value FROM {f}",
            f"SELECT 'Column', '{column}', 'Histogram.abs.' || v, CAST(c AS DOUBLE) FROM {f}",
            f"SELECT 'Column', '{column}', 'Histogram.ratio.' || v, round(c / n, 6) FROM {f}",
        ]
    return " UNION ALL ".join(parts)


def suggest_categorical_edge(spark: SparkSession, folder: str) -> DataFrame:
    """A range of exactly as many values as may be listed is suggested, one of one more is not."""
    frame = EDGES.frame(spark, folder).select("code99", "code100")
    found = S.ConstraintSuggestionRunner(spark).onData(frame).addConstraintRule(S.categorical_range).run()
    return found.as_frame().select("column_name", "rule", "description", F.length("constraint").alias("size"))


EDGE_SQL = f"""
SELECT column_name, 'CategoricalRange' AS rule, column_name || ' holds one of ' || values_ || ' values' AS description,
    size + length('.isContainedIn(''' || column_name || ''', [])') + 2 * values_ + 2 * (values_ - 1) AS size
FROM ({
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS values_, (SELECT sum(length(v)) FROM "
        f"(SELECT DISTINCT {c} AS v FROM {EDGES.sql})) AS size FROM {EDGES.sql}"
        for c in ("code99", "code100")
    )
}) WHERE values_ <= 100
"""


def approx_where(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates under a row condition stay within what was asked for; the exact values are beside them."""
    orders = table(spark, folder, "orders")
    metrics = [ApproxQuantile("o_totalprice", 0.25, 0.05, TOTAL), ApproxCountDistinct("o_custkey", TOTAL, 0.02)]
    found = AnalysisRunner(spark).onData(orders).addAnalyzers(metrics).asDataFrame()
    quartile = found.where("name LIKE 'ApproxQuantile%'").select("value").scalar()
    distinct = found.where("name = 'ApproxCountDistinct'").select("value").scalar()
    kept, price = orders.where(TOTAL), F.col("o_totalprice")
    exact = F.count_distinct("o_custkey")
    return kept.agg(
        F.count("*").alias("rows"),
        exact.alias("customers"),
        (F.abs(distinct - exact) <= 5 * 0.02 * exact).alias("customers_in_bound"),
        (
            (F.count_if(price < quartile) <= F.count("*") * 0.3) & (F.count_if(price <= quartile) >= F.count("*") * 0.2)
        ).alias("quartile_in_bound"),
    )


APPROX_SQL = f"""
SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, TRUE AS customers_in_bound, TRUE AS quartile_in_bound
FROM orders WHERE {TOTAL}
"""


def _rulings(check: Check, frame: DataFrame) -> DataFrame:
    verified = VerificationSuite(frame.sparkSession).onData(frame).addCheck(check).run()
    found = VerificationResult.checkResultsAsDataFrame(frame.sparkSession, verified)
    return found.select("constraint", "constraint_status")


def check_has_data_type(spark: SparkSession, folder: str) -> DataFrame:
    frame = table(spark, folder, "orders").select(
        F.expr("concat('-', o_orderkey)").alias("whole"),
        F.expr("concat(o_orderkey, '.5')").alias("part"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN concat('- ', o_orderkey) ELSE '1' END").alias("blank"),
    )
    check = Check(spark, CheckLevel.Warning, "types")
    for column in frame.columns:
        check.hasDataType(column, "Integral").hasDataType(column, "Fractional")
    return _rulings(check, frame)


def check_is_non_negative(spark: SparkSession, folder: str) -> DataFrame:
    check = Check(spark, CheckLevel.Error, "signs").isNonNegative("c_custkey").isNonNegative("c_acctbal")
    return _rulings(check, table(spark, folder, "customer"))


def _ruled(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{text}' AS \"constraint\", CASE WHEN {holds} THEN 'Success' ELSE 'Failure' END AS constraint_status"
        for text, holds in rows
    )


TYPES_SQL = _ruled(
    [
        ("hasDataType(whole, Integral)", "TRUE"),
        ("hasDataType(whole, Fractional)", "TRUE"),
        ("hasDataType(part, Integral)", "(SELECT count(*) = 0 FROM orders)"),
        ("hasDataType(part, Fractional)", "TRUE"),
        ("hasDataType(blank, Integral)", "(SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) = 0 FROM orders)"),
        ("hasDataType(blank, Fractional)", "(SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) = 0 FROM orders)"),
    ]
)
SIGNS_SQL = _ruled(
    [
        ("isNonNegative(c_custkey)", "(SELECT min(c_custkey) >= 0 FROM customer)"),
        ("isNonNegative(c_acctbal)", "(SELECT min(c_acctbal) >= 0 FROM customer)"),
    ]
)


def stamp_text_time(spark: SparkSession, folder: str) -> DataFrame:
    """The run's time as text, as the flat table of a database holds it, taken from the data here."""
    events = table(spark, folder, "events")
    last = events.agg(F.max("ts")).first()[0]
    found = AnalysisRunner(spark).onData(events).addAnalyzers([Size(), Maximum("value")]).run()
    return rounded(with_text_time(stamp(found.success_frame(), "nightly", last, "n1")))


STAMP_SQL = f"""
SELECT *, 'nightly' AS tag, 'n1' AS run, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events) AS timestamp FROM ({
    expected(
        [
            ("Dataset", "*", "Size", "SELECT count(*) FROM events"),
            ("Column", "value", "Maximum", "SELECT max(value) FROM events"),
        ]
    )
})
"""


def schema_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and types of a table, each with how many rows hold a value there."""
    orders = ORDERS.frame(spark, folder)
    counted = analysed(orders, [Completeness(name) for name in orders.columns]).select(
        F.col("instance").alias("column"), F.col("value").alias("completeness")
    )
    return schema_frame(orders).drop("position").join(counted, "column")


SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, round(count({c}) / count(*), 6) AS completeness FROM {ORDERS.sql}"
    for c, t in {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
        "priority": "string",
    }.items()
)


SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


def csv_options_override(spark: SparkSession, folder: str) -> DataFrame:
    """Options from a mapping, one of them overridden: a file with semicolons read with them."""
    path = scratch_folder(spark, "csv")
    table(spark, folder, "supplier").write.csv(path, header=True, sep=";")
    base = {"header": "true", "sep": ","}
    read = read_csv(spark, path, SUPPLIER, options={**base, "sep": ";"})
    return analysed(read, [Size(), Minimum("s_suppkey"), Sum("s_nationkey"), Completeness("s_name")])


CSV_SQL = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM supplier"),
        ("Column", "s_suppkey", "Minimum", "SELECT min(s_suppkey) FROM supplier"),
        ("Column", "s_nationkey", "Sum", "SELECT sum(s_nationkey) FROM supplier"),
        ("Column", "s_name", "Completeness", "SELECT count(s_name) / count(*) FROM supplier"),
    ]
)


def failed_metrics_lazy(spark: SparkSession, folder: str) -> DataFrame:
    """A lazy frame with the metrics that fail as rows: one names no column, one breaks on a value."""
    metrics = [
        Size(),
        Mean("o_totalprice"),
        Mean("no such column"),
        Mean("o_orderstatus"),
        Compliance("numbers", "cast(o_orderstatus AS int) > 0"),
        Minimum("o_totalprice", "o_totalprice < 0"),
    ]
    found = AnalysisRunner(spark).onData(table(spark, folder, "orders")).addAnalyzers(metrics)
    return rounded(found.asDataFrame(failures=True)).select("entity", "instance", "name", "value", F.col("error").isNotNull().alias("failed"))


FAILED_SQL = f"""
SELECT *, FALSE AS failed FROM ({
    expected(
        [
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
            ("Column", "o_totalprice", "Mean", "SELECT avg(o_totalprice) FROM orders"),
        ]
    )
})
UNION ALL SELECT 'Column', 'no such column', 'Mean', NULL, TRUE
UNION ALL SELECT 'Column', 'o_orderstatus', 'Mean', NULL, TRUE
UNION ALL SELECT 'Column', 'numbers', 'Compliance', NULL, TRUE
UNION ALL SELECT 'Column', 'o_totalprice', 'Minimum', NULL, TRUE
"""


def history_two_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics that differ in a table, a predicate or a row condition alone keep their own values."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    half = value_set(customer.where("c_custkey % 2 = 0"), "c_custkey")
    every = value_set(customer, "c_custkey")
    metrics = [
        ContainedInTable("o_custkey", half, label="even customers"),
        ContainedInTable("o_custkey", every, label="customers"),
        Compliance("priced", "o_totalprice > 50000"),
        Compliance("priced", "o_totalprice > 90000"),
        Size(),
        Size("o_totalprice > 90000"),
    ]
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "history"))
    runner = AnalysisRunner(spark).onData(orders).addAnalyzers(metrics)
    key = ResultKey(spark, 1_700_000_000_000, {"value": "tagged"})
    for _ in range(2):
        runner.useRepository(repository).saveOrAppendResult(key).run()
    repository.compact(1_800_000_000_000)
    return rounded(repository.load().getSuccessMetricsAsDataFrame(["value"]))


KNOWN = "SELECT count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {})) / count(*) FROM orders"
TWO_TABLES_SQL = f"""
SELECT *, CASE WHEN name = 'Size' AND value < (SELECT count(*) FROM orders) THEN 'o_totalprice > 90000' END AS filter,
    1700000000000 AS dataset_date, 'tagged' AS tag_value
FROM ({
    expected(
        [
            ("Column", "o_custkey contained in even customers", "Compliance", KNOWN.format("c_custkey % 2 = 0")),
            ("Column", "o_custkey contained in customers", "Compliance", KNOWN.format("TRUE")),
            ("Column", "priced", "Compliance", "SELECT count(*) FILTER (WHERE o_totalprice > 50000) / count(*) FROM orders"),
            ("Column", "priced", "Compliance", "SELECT count(*) FILTER (WHERE o_totalprice > 90000) / count(*) FROM orders"),
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
            ("Dataset", "*", "Size", "SELECT count(*) FROM orders WHERE o_totalprice > 90000"),
        ]
    )
})
"""
DAY = "cast(cast(ts AS date) AS string)"


def incremental_added_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics saved in turns keep all their parts: nothing is overwritten by what is added later."""
    events, store = table(spark, folder, "events"), StateStore(spark, scratch_folder(spark, "states"))
    first, later = [Size(), Mean("value")], [Sum("value"), CountDistinct("user_id")]
    store.save(events, first, F.expr(DAY))
    store.save(events, later, F.expr(DAY))
    return rounded(store.metrics(events, [*first, *later]), 4)


def incremental_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the days as one part, and the other days as they are."""
    events, store = table(spark, folder, "events"), StateStore(spark, scratch_folder(spark, "states"))
    metrics = [Size(), Mean("value"), Sum("value"), CountDistinct("user_id")]
    store.save(events, metrics, F.expr(DAY))
    days = [row.day for row in events.select(F.expr(DAY).alias("day")).distinct().orderBy("day").collect()]
    store.roll_up("early", days[: len(days) // 2])
    return rounded(store.metrics(events, metrics), 4)


WHOLE_SQL = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM events"),
        ("Column", "value", "Mean", "SELECT avg(value) FROM events"),
        ("Column", "value", "Sum", "SELECT sum(value) FROM events"),
        ("Column", "user_id", "CountDistinct", "SELECT count(DISTINCT user_id) FROM events"),
    ],
    4,
)

QUERIES = {
    "histogram_all_bins": Query(histogram_all_bins, _bins_sql()),
    "suggest_categorical_edge": Query(suggest_categorical_edge, EDGE_SQL),
    "approx_where": Query(approx_where, APPROX_SQL),
    "check_has_data_type": Query(check_has_data_type, TYPES_SQL),
    "check_is_non_negative": Query(check_is_non_negative, SIGNS_SQL),
    "stamp_text_time": Query(stamp_text_time, STAMP_SQL),
    "schema_listing": Query(schema_listing, SCHEMA_SQL),
    "csv_options_override": Query(csv_options_override, CSV_SQL),
    "failed_metrics_lazy": Query(failed_metrics_lazy, FAILED_SQL),
    "history_two_tables": Query(history_two_tables, TWO_TABLES_SQL),
    "incremental_added_metric": Query(incremental_added_metric, WHOLE_SQL),
    "incremental_rollup": Query(incremental_rollup, WHOLE_SQL),
}

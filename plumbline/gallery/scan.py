"""Metrics of the shared scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.gallery.base import ORDERS, Derived, Query, analysed, expected, table
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    CountDistinct,
    DataType,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MinLength,
    PatternMatch,
    Size,
    StandardDeviation,
    Sum,
)
from plumbline.plans.analysis import AnalysisRunner, AnalyzerContext

MANY = "l_quantity > 10"
DEAR = "o_totalprice > 100000"
PHONE = r"\+1 \([0-9]{3}\) 555-[0-9]{4}"


def profile_scan(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [
        Size(),
        Size(MANY),
        Completeness("l_shipdate"),
        Compliance("discounted", "l_discount > 0.05"),
        Compliance("discounted many", "l_discount > 0.05", MANY),
        Correlation("l_quantity", "l_extendedprice"),
        Minimum("l_extendedprice"),
        Maximum("l_extendedprice"),
        Mean("l_extendedprice"),
        StandardDeviation("l_extendedprice"),
        Mean("l_tax", MANY),
        Sum("l_quantity", MANY),
    ]
    return analysed(table(spark, folder, "lineitem"), metrics, 4)


PROFILE_SCAN = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM lineitem"),
        ("Dataset", "*", "Size", f"SELECT count(*) FROM lineitem WHERE {MANY}"),
        ("Column", "l_shipdate", "Completeness", "SELECT count(l_shipdate) / count(*) FROM lineitem"),
        (
            "Column",
            "discounted",
            "Compliance",
            "SELECT count(*) FILTER (WHERE l_discount > 0.05) / count(*) FROM lineitem",
        ),
        (
            "Column",
            "discounted many",
            "Compliance",
            f"SELECT count(*) FILTER (WHERE l_discount > 0.05) / count(*) FROM lineitem WHERE {MANY}",
        ),
        (
            "Multicolumn",
            "l_quantity,l_extendedprice",
            "Correlation",
            "SELECT corr(l_quantity, l_extendedprice) FROM lineitem",
        ),
        ("Column", "l_extendedprice", "Minimum", "SELECT min(l_extendedprice) FROM lineitem"),
        ("Column", "l_extendedprice", "Maximum", "SELECT max(l_extendedprice) FROM lineitem"),
        ("Column", "l_extendedprice", "Mean", "SELECT avg(l_extendedprice) FROM lineitem"),
        (
            "Column",
            "l_extendedprice",
            "StandardDeviation",
            "SELECT stddev_pop(l_extendedprice) FROM lineitem",
        ),
        ("Column", "l_tax", "Mean", f"SELECT avg(l_tax) FROM lineitem WHERE {MANY}"),
        ("Column", "l_quantity", "Sum", f"SELECT sum(l_quantity) FROM lineitem WHERE {MANY}"),
    ],
    4,
)


LINEITEM_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
LINEITEM_COLUMNS = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
STATISTICS = {
    Minimum: "min",
    Maximum: "max",
    Mean: "avg",
    StandardDeviation: "stddev_pop",
}


def lineitem_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every column's completeness and every number's statistics: 44 metrics in one aggregation."""
    metrics = [Size(), *[Completeness(column) for column in LINEITEM_COLUMNS]]
    metrics += [metric(column) for column in LINEITEM_NUMBERS for metric in STATISTICS]
    return analysed(table(spark, folder, "lineitem"), metrics, 4)


LINEITEM_PROFILE = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM lineitem"),
        *[
            ("Column", column, "Completeness", f"SELECT count({column}) / count(*) FROM lineitem")
            for column in LINEITEM_COLUMNS
        ],
        *[
            ("Column", column, metric.__name__, f"SELECT {function}({column}) FROM lineitem")
            for column in LINEITEM_NUMBERS
            for metric, function in STATISTICS.items()
        ],
    ],
    4,
)


def basic_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Under one common condition, which filters the scan."""
    metrics = [
        metric("o_totalprice", DEAR) for metric in (Minimum, Maximum, Mean, Sum, StandardDeviation)
    ]
    return analysed(table(spark, folder, "orders"), metrics, 2)


def size_where(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(table(spark, folder, "orders"), [Size(), Size(DEAR)])


def completeness_where(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [Completeness("priority"), Completeness("PRIORITY", DEAR)]
    return analysed(ORDERS.frame(spark, folder), metrics)


def compliance_null(spark: SparkSession, folder: str) -> DataFrame:
    """A NULL predicate is not met, and its row still counts."""
    metrics = [
        Compliance("priority <> '5-LOW'"),
        Compliance("low", "priority = '5-LOW'", DEAR),
    ]
    return analysed(ORDERS.frame(spark, folder), metrics)


def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [
        Correlation("l_quantity", "l_extendedprice"),
        Correlation("l_discount", "l_tax"),
        Correlation("l_quantity", "l_discount", MANY),
    ]
    return analysed(table(spark, folder, "lineitem"), metrics)


def approx_distinct_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Each estimate beside the exact number, three standard errors being the bound."""
    frames = []
    for name, column in (("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("events", "user_id")):
        runner = AnalysisRunner(spark).onData(table(spark, folder, name))
        frames.append(runner.addAnalyzers([ApproxCountDistinct(column), CountDistinct(column)]).asDataFrame())
    by_name = {
        name: F.max(F.when(F.col("name") == name, F.col("value")))
        for name in ("ApproxCountDistinct", "CountDistinct")
    }
    both = frames[0].union(frames[1]).union(frames[2])
    return both.groupBy("instance").agg(
        by_name["CountDistinct"].cast("bigint").alias("exact"),
        (
            F.abs(by_name["ApproxCountDistinct"] - by_name["CountDistinct"])
            <= 3 * 0.05 * by_name["CountDistinct"]
        ).alias("in_bound"),
    )


APPROX_DISTINCT = " UNION ALL ".join(
    f"SELECT '{column}' AS instance, count(DISTINCT {column}) AS exact, TRUE AS in_bound FROM {name}"
    for name, column in (("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("events", "user_id"))
)


def approx_quantile_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The exact quartiles, and whether the estimates' ranks are within the asked error."""
    orders = table(spark, folder, "orders")
    error, asked = 0.05, [0.25, 0.75]
    estimates = [ApproxQuantile("o_totalprice", q, error) for q in asked]
    exact = [ApproxQuantile("o_totalprice", q, 0.0) for q in asked]
    found = AnalysisRunner(spark).onData(orders).addAnalyzers([*estimates, *exact]).run()
    checks = []
    for q, estimate, truth in zip(asked, estimates, exact):
        value = found.value(estimate)
        # A value that repeats covers a span of ranks.
        below = F.count_if(F.col("o_totalprice") < value) / F.count("o_totalprice")
        up_to = F.count_if(F.col("o_totalprice") <= value) / F.count("o_totalprice")
        inside = (below <= q + error) & (up_to >= q - error)
        checks.append(
            F.struct(
                F.lit(q).alias("quantile"), F.lit(found.value(truth)).alias("exact"), inside.alias("in_bound")
            )
        )
    return orders.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


APPROX_QUANTILE = " UNION ALL ".join(
    f"SELECT CAST({q} AS DOUBLE) AS quantile, quantile_disc(o_totalprice, {q}) AS exact, "
    "TRUE AS in_bound FROM orders"
    for q in (0.25, 0.75)
)


def quantiles_exact(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [
        ApproxQuantiles("o_totalprice", [0.25, 0.5, 0.75, 0.9], 0.0),
        ApproxQuantiles("o_totalprice", [0.5], 0.0, "o_orderstatus = 'F'"),
        ApproxQuantiles("o_custkey", [0.0, 0.1, 1.0], 0.0),
    ]
    return analysed(table(spark, folder, "orders"), metrics)


MIXED = Derived(
    "events",
    {
        "mixed": "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id AS STRING) "
        "WHEN 2 THEN concat('-', CAST(event_id AS STRING)) "
        "WHEN 3 THEN concat(CAST(event_id AS STRING), '.25') WHEN 4 THEN '.5' WHEN 5 THEN 'true' "
        "WHEN 6 THEN CASE WHEN event_id % 3 = 0 THEN 'false' ELSE '1e5' END ELSE event_type END"
    },
)


def datatype_mixed(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [DataType("mixed"), DataType("value"), DataType("user_id", "event_id % 2 = 0")]
    return analysed(MIXED.frame(spark, folder), metrics)


def _types_sql(instance: str, classify: str, source: str) -> str:
    rows = []
    for kind in DataType.CLASSES:
        count = f"count(*) FILTER (WHERE ({classify}) = '{kind}')"
        rows.append(("Column", instance, f"DataType.abs.{kind}", f"SELECT {count} FROM {source}"))
        rows.append(
            ("Column", instance, f"DataType.ratio.{kind}", f"SELECT {count} / count(*) FROM {source}")
        )
    return expected(rows)


DATATYPE_MIXED = " UNION ALL ".join(
    [
        _types_sql(
            "mixed",
            f"CASE WHEN mixed IS NULL THEN 'Unknown' "
            f"WHEN regexp_matches(mixed, '{patterns.INTEGRAL}') THEN 'Integral' "
            f"WHEN regexp_matches(mixed, '{patterns.FRACTIONAL}') THEN 'Fractional' "
            f"WHEN mixed IN {patterns.BOOLEANS} THEN 'Boolean' ELSE 'String' END",
            f"{MIXED.sql} AS t",
        ),
        _types_sql("value", "CASE WHEN value IS NULL THEN 'Unknown' ELSE 'Fractional' END", "events"),
        _types_sql(
            "user_id",
            "CASE WHEN user_id IS NULL THEN 'Unknown' ELSE 'Integral' END",
            "(SELECT * FROM events WHERE event_id % 2 = 0) AS t",
        ),
    ]
)


def length_bounds(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [MinLength("text"), MaxLength("text"), MaxLength("source", "lang = 'en'")]
    return analysed(table(spark, folder, "documents"), metrics)


def pattern_phone(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [PatternMatch("text", PHONE), PatternMatch("text", PHONE, "lang = 'en'")]
    return analysed(table(spark, folder, "documents"), metrics)


def failed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What can be computed is; what cannot is told apart by kind of error."""
    lineitem = table(spark, folder, "lineitem")
    result = (
        AnalysisRunner(spark)
        .onData(lineitem)
        .addAnalyzers(
            [
                Size(),
                Mean("l_tax"),
                Mean("l_comment"),
                Mean("l_returnflag"),
                Compliance("l_returnflag + 1"),
                Compliance("bad cast", "cast(l_returnflag AS int) = 1"),
                PatternMatch("l_returnflag", "(["),
                ApproxQuantile("l_tax", 1.5),
                Mean("l_quantity", "l_quantity < 0"),
            ]
        )
        .run()
    )
    good = AnalyzerContext.successMetricsAsDataFrame(spark, result)
    failed = AnalyzerContext.failedMetricsAsDataFrame(spark, result)
    return good.select("instance", "name", F.round("value", 6).alias("value"), F.lit("").alias("error")).union(
        failed.select("instance", "name", F.lit(None).cast("double"), "error")
    )


FAILED_METRICS = """
SELECT '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, '' AS error FROM lineitem
UNION ALL SELECT 'l_tax', 'Mean', round(avg(l_tax), 6), '' FROM lineitem
UNION ALL SELECT * FROM (VALUES
  ('l_comment', 'Mean', CAST(NULL AS DOUBLE), 'MissingColumn'),
  ('l_returnflag', 'Mean', NULL, 'WrongType'),
  ('l_returnflag + 1', 'Compliance', NULL, 'InvalidPredicate'),
  ('bad cast', 'Compliance', NULL, 'BadValue'),
  ('l_returnflag', 'PatternMatch', NULL, 'IllegalParameter'),
  ('l_tax', 'ApproxQuantile', NULL, 'IllegalParameter'),
  ('l_quantity', 'Mean', NULL, 'EmptyState')) AS v
"""

QUERIES = {
    "profile_scan": Query(profile_scan, PROFILE_SCAN),
    "lineitem_profile": Query(lineitem_profile, LINEITEM_PROFILE),
    "basic_statistics": Query(
        basic_statistics,
        expected(
            [
                ("Column", "o_totalprice", name, f"SELECT {function}(o_totalprice) FROM orders WHERE {DEAR}")
                for name, function in (
                    ("Minimum", "min"),
                    ("Maximum", "max"),
                    ("Mean", "avg"),
                    ("Sum", "sum"),
                    ("StandardDeviation", "stddev_pop"),
                )
            ],
            2,
        ),
    ),
    "size_where": Query(
        size_where,
        expected(
            [
                ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
                ("Dataset", "*", "Size", f"SELECT count(*) FROM orders WHERE {DEAR}"),
            ]
        ),
    ),
    "completeness_where": Query(
        completeness_where,
        expected(
            [
                (
                    "Column",
                    "priority",
                    "Completeness",
                    f"SELECT count(priority) / count(*) FROM {ORDERS.sql}",
                ),
                (
                    "Column",
                    "PRIORITY",
                    "Completeness",
                    f"SELECT count(priority) / count(*) FROM {ORDERS.sql} WHERE {DEAR}",
                ),
            ]
        ),
    ),
    "compliance_null": Query(
        compliance_null,
        expected(
            [
                (
                    "Column",
                    "priority <> ''5-LOW''",
                    "Compliance",
                    "SELECT count(*) FILTER (WHERE priority <> '5-LOW') / count(*) "
                    f"FROM {ORDERS.sql}",
                ),
                (
                    "Column",
                    "low",
                    "Compliance",
                    "SELECT count(*) FILTER (WHERE priority = '5-LOW') / count(*) "
                    f"FROM {ORDERS.sql} WHERE {DEAR}",
                ),
            ]
        ),
    ),
    "correlation_pairs": Query(
        correlation_pairs,
        expected(
            [
                ("Multicolumn", f"{a},{b}", "Correlation", f"SELECT corr({a}, {b}) FROM lineitem{where}")
                for a, b, where in (
                    ("l_quantity", "l_extendedprice", ""),
                    ("l_discount", "l_tax", ""),
                    ("l_quantity", "l_discount", f" WHERE {MANY}"),
                )
            ]
        ),
    ),
    "approx_distinct_bound": Query(approx_distinct_bound, APPROX_DISTINCT),
    "approx_quantile_bound": Query(approx_quantile_bound, APPROX_QUANTILE),
    "quantiles_exact": Query(
        quantiles_exact,
        expected(
            [
                (
                    "Column",
                    column,
                    f"ApproxQuantiles-{q}",
                    f"SELECT quantile_disc({column}, {q}) FROM orders{where}",
                )
                for column, q, where in (
                    ("o_totalprice", 0.25, ""),
                    ("o_totalprice", 0.5, ""),
                    ("o_totalprice", 0.75, ""),
                    ("o_totalprice", 0.9, ""),
                    ("o_totalprice", 0.5, " WHERE o_orderstatus = 'F'"),
                    ("o_custkey", 0.0, ""),
                    ("o_custkey", 0.1, ""),
                    ("o_custkey", 1.0, ""),
                )
            ]
        ),
    ),
    "datatype_mixed": Query(datatype_mixed, DATATYPE_MIXED),
    "length_bounds": Query(
        length_bounds,
        expected(
            [
                ("Column", "text", "MinLength", "SELECT min(length(text)) FROM documents"),
                ("Column", "text", "MaxLength", "SELECT max(length(text)) FROM documents"),
                ("Column", "source", "MaxLength", "SELECT max(length(source)) FROM documents WHERE lang = 'en'"),
            ]
        ),
    ),
    "pattern_phone": Query(
        pattern_phone,
        expected(
            [
                (
                    "Column",
                    "text",
                    "PatternMatch",
                    f"SELECT count(*) FILTER (WHERE regexp_matches(text, '{PHONE}')) / count(*) "
                    f"FROM documents{where}",
                )
                for where in ("", " WHERE lang = 'en'")
            ]
        ),
    ),
    "failed_metrics": Query(failed_metrics, FAILED_METRICS),
}

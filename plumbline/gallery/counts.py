"""Metrics read off value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.gallery.base import EVENTS, LINEITEM, ORDERS, Query, analysed, expected, table
from plumbline.operators.metrics import (
    CountDistinct,
    Distinctness,
    Entropy,
    Histogram,
    MutualInformation,
    Uniqueness,
    UniqueValueRatio,
)

MANY = "l_quantity > 10"
COLUMN_SETS = [
    (["l_partkey", "l_suppkey"], None),
    (["l_orderkey", "l_linenumber"], MANY),
    (["line", "supplier"], None),
    (["supplier"], None),
    (["l_orderkey", "line", "supplier"], MANY),
]


def _over_sets(metric):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        metrics = [metric(columns, where) for columns, where in COLUMN_SETS]
        return analysed(LINEITEM.frame(spark, folder), metrics)

    return run


def _over_sets_sql(name: str, value: str) -> str:
    rows = []
    for columns, where in COLUMN_SETS:
        keys = ", ".join(columns)
        present = " OR ".join(f"{column} IS NOT NULL" for column in columns)
        condition = f"({present})" + (f" AND {where}" if where else "")
        rows.append(
            (
                "Column" if len(columns) == 1 else "Multicolumn",
                ",".join(columns),
                name,
                f"SELECT {value} FROM (SELECT {keys}, count(*) AS c FROM {LINEITEM.sql} "
                f"WHERE {condition} GROUP BY {keys})",
            )
        )
    return expected(rows)


def shared_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Five metrics on one pair of columns, in either order: one grouping serves all."""
    pair, turned = ["l_returnflag", "l_shipdate"], ["l_shipdate", "l_returnflag"]
    metrics = [
        CountDistinct(pair),
        Distinctness(turned),
        Uniqueness(pair),
        UniqueValueRatio(turned),
        MutualInformation(pair),
    ]
    return analysed(table(spark, folder, "lineitem"), metrics)


MI_SQL = """
WITH ab AS (SELECT {a} AS a, {b} AS b, count(*) AS c FROM {source}
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
     m AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY a) AS ca,
                  sum(c) OVER (PARTITION BY b) AS cb FROM ab)
SELECT sum(c / n * ln(c * n / (ca * cb))) FROM m
"""

SHARED_SQL = expected(
    [
        (
            "Multicolumn",
            instance,
            name,
            f"SELECT {value} FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag, l_shipdate)",
        )
        for instance, name, value in (
            ("l_returnflag,l_shipdate", "CountDistinct", "count(*)"),
            ("l_shipdate,l_returnflag", "Distinctness", "count(*) / sum(c)"),
            ("l_returnflag,l_shipdate", "Uniqueness", "count(*) FILTER (WHERE c = 1) / sum(c)"),
            ("l_shipdate,l_returnflag", "UniqueValueRatio", "count(*) FILTER (WHERE c = 1) / count(*)"),
        )
    ]
    + [
        (
            "Multicolumn",
            "l_returnflag,l_shipdate",
            "MutualInformation",
            MI_SQL.format(a="l_returnflag", b="l_shipdate", source="lineitem"),
        )
    ]
)


def entropy(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [Entropy("priority"), Entropy("o_custkey"), Entropy("priority", "o_totalprice > 100000")]
    return analysed(ORDERS.frame(spark, folder), metrics)


ENTROPY_SQL = expected(
    [
        (
            "Column",
            column,
            "Entropy",
            f"SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n "
            f"FROM {ORDERS.sql} WHERE {column} IS NOT NULL{where} GROUP BY {column})",
        )
        for column, where in (
            ("priority", ""),
            ("o_custkey", ""),
            ("priority", " AND o_totalprice > 100000"),
        )
    ]
)


def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [
        MutualInformation(["l_returnflag", "l_shipdate"]),
        MutualInformation(["line", "supplier"], MANY),
        MutualInformation(["l_partkey", "l_suppkey"]),
    ]
    return analysed(LINEITEM.frame(spark, folder), metrics)


MUTUAL_SQL = expected(
    [
        ("Multicolumn", f"{a},{b}", "MutualInformation", MI_SQL.format(a=a, b=b, source=source))
        for a, b, source in (
            ("l_returnflag", "l_shipdate", "lineitem"),
            ("line", "supplier", f"(SELECT * FROM {LINEITEM.sql} WHERE {MANY})"),
            ("l_partkey", "l_suppkey", "lineitem"),
        )
    ]
)


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [Histogram("kind"), Histogram("kind", where="value > 50")]
    return analysed(EVENTS.frame(spark, folder), metrics)


def histogram_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 commonest of many values; the number of bins still counts all of them."""
    return analysed(table(spark, folder, "lineitem"), [Histogram("l_partkey", 20)])


def _histogram_sql(column: str, source: str, top: int) -> str:
    return f"""
    SELECT 'Column' AS entity, '{column}' AS instance, u.name, round(u.value, 6) AS value FROM (
      WITH f AS (SELECT coalesce(CAST({column} AS VARCHAR), 'NullValue') AS v, count(*) AS c
                 FROM {source} GROUP BY 1),
           r AS (SELECT v, c, sum(c) OVER () AS n, row_number() OVER (ORDER BY c DESC, v) AS i FROM f)
      SELECT 'Histogram.bins' AS name, CAST(count(*) AS DOUBLE) AS value FROM f
      UNION ALL SELECT 'Histogram.abs.' || v, CAST(c AS DOUBLE) FROM r WHERE i <= {top}
      UNION ALL SELECT 'Histogram.ratio.' || v, CAST(c / n AS DOUBLE) FROM r WHERE i <= {top}) AS u
    """


QUERIES = {
    "count_distinct_multi": Query(_over_sets(CountDistinct), _over_sets_sql("CountDistinct", "count(*)")),
    "distinctness": Query(_over_sets(Distinctness), _over_sets_sql("Distinctness", "count(*) / sum(c)")),
    "uniqueness": Query(
        _over_sets(Uniqueness), _over_sets_sql("Uniqueness", "count(*) FILTER (WHERE c = 1) / sum(c)")
    ),
    "unique_value_ratio": Query(
        _over_sets(UniqueValueRatio),
        _over_sets_sql("UniqueValueRatio", "count(*) FILTER (WHERE c = 1) / count(*)"),
    ),
    "shared_grouping": Query(shared_grouping, SHARED_SQL),
    "entropy": Query(entropy, ENTROPY_SQL),
    "mutual_information": Query(mutual_information, MUTUAL_SQL),
    "histogram": Query(
        histogram,
        _histogram_sql("kind", EVENTS.sql, 1000)
        + " UNION ALL "
        + _histogram_sql("kind", f"(SELECT * FROM {EVENTS.sql} WHERE value > 50)", 1000),
    ),
    "histogram_topk": Query(histogram_topk, _histogram_sql("l_partkey", "lineitem", 20)),
}

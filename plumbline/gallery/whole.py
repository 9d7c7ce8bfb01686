"""One run with metrics of every family over ``lineitem``, with and without a row condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.gallery.base import LINEITEM, Query, analysed, expected
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    CountDistinct,
    DataType,
    Distinctness,
    Entropy,
    Histogram,
    Maximum,
    MaxLength,
    Mean,
    Metric,
    Minimum,
    MinLength,
    MutualInformation,
    PatternMatch,
    Size,
    StandardDeviation,
    Sum,
    Uniqueness,
    UniqueValueRatio,
)

SMALL = "l_quantity <= 20"
FLAGS = ["l_returnflag", "l_linestatus"]
NUMBERS = [Minimum, Maximum, Mean, Sum, StandardDeviation]


def _metrics() -> list[Metric]:
    moments = [kind("l_tax", SMALL) for kind in NUMBERS] + [Correlation("l_tax", "l_discount")]
    shares = [
        Completeness("line"),
        Completeness("supplier", SMALL),
        Compliance("taxed", "l_tax > 0.01 AND l_discount < 0.09", SMALL),
        PatternMatch("l_returnflag", "[AN]"),
    ]
    shapes = [MinLength("l_linestatus"), MaxLength("l_returnflag", SMALL), DataType("l_returnflag")]
    ranks = [ApproxQuantiles("l_extendedprice", [0.1, 0.99], 0.0, SMALL), ApproxQuantiles("l_tax", [0.5], 0.0)]
    values = [
        MutualInformation(FLAGS),
        Entropy("l_returnflag"),
        Histogram("l_linestatus"),
        CountDistinct(FLAGS),
        Uniqueness(["l_orderkey", "l_partkey"], SMALL),
        UniqueValueRatio("l_partkey", SMALL),
        Distinctness("l_orderkey", SMALL),
        ApproxCountDistinct("l_linestatus"),
    ]
    return [*values, *ranks, *shapes, *moments, *shares, Size(), Size(SMALL)]


def full_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(LINEITEM.frame(spark, folder), _metrics(), 4)


def _sql() -> str:
    every, small = LINEITEM.sql, f"(SELECT * FROM {LINEITEM.sql} WHERE {SMALL})"

    def groups(columns: str, source: str) -> str:
        return f"(SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM {source} GROUP BY {columns})"

    once = "count(*) FILTER (WHERE c = 1)"
    functions = {"Minimum": "min", "Maximum": "max", "Mean": "avg", "Sum": "sum", "StandardDeviation": "stddev_pop"}
    pairs = f"SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS c FROM {every} GROUP BY 1, 2"
    sides = "sum(c) OVER () AS n, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb"
    flags = "Multicolumn", "l_returnflag,l_linestatus"
    rows = [
        ("Dataset", "*", "Size", f"SELECT count(*) FROM {every}"),
        ("Dataset", "*", "Size", f"SELECT count(*) FROM {small}"),
        ("Column", "line", "Completeness", f"SELECT count(line) / count(*) FROM {every}"),
        ("Column", "supplier", "Completeness", f"SELECT count(supplier) / count(*) FROM {small}"),
        (
            "Column",
            "taxed",
            "Compliance",
            f"SELECT count(*) FILTER (WHERE l_tax > 0.01 AND l_discount < 0.09) / count(*) FROM {small}",
        ),
        (
            "Column",
            "l_returnflag",
            "PatternMatch",
            f"SELECT count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) / count(*) FROM {every}",
        ),
        ("Column", "l_linestatus", "MinLength", f"SELECT min(length(l_linestatus)) FROM {every}"),
        ("Column", "l_returnflag", "MaxLength", f"SELECT max(length(l_returnflag)) FROM {small}"),
        *[("Column", "l_tax", name, f"SELECT {function}(l_tax) FROM {small}") for name, function in functions.items()],
        ("Multicolumn", "l_tax,l_discount", "Correlation", f"SELECT corr(l_tax, l_discount) FROM {every}"),
        *[
            (
                "Column",
                "l_extendedprice",
                f"ApproxQuantiles-{q}",
                f"SELECT quantile_disc(l_extendedprice, {q}) FROM {small}",
            )
            for q in (0.1, 0.99)
        ],
        ("Column", "l_tax", "ApproxQuantiles-0.5", f"SELECT quantile_disc(l_tax, 0.5) FROM {every}"),
        (
            *flags,
            "MutualInformation",
            f"WITH ab AS ({pairs}), m AS (SELECT c, {sides} FROM ab) SELECT sum(c / n * ln(c * n / (ca * cb))) FROM m",
        ),
        (*flags, "CountDistinct", f"SELECT count(*) FROM {groups('l_returnflag, l_linestatus', every)}"),
        ("Column", "l_returnflag", "Entropy", f"SELECT -sum(c / n * ln(c / n)) FROM {groups('l_returnflag', every)}"),
        (
            "Multicolumn",
            "l_orderkey,l_partkey",
            "Uniqueness",
            f"SELECT {once} / sum(c) FROM {groups('l_orderkey, l_partkey', small)}",
        ),
        ("Column", "l_partkey", "UniqueValueRatio", f"SELECT {once} / count(*) FROM {groups('l_partkey', small)}"),
        ("Column", "l_orderkey", "Distinctness", f"SELECT count(*) / sum(c) FROM {groups('l_orderkey', small)}"),
        ("Column", "l_linestatus", "ApproxCountDistinct", f"SELECT count(DISTINCT l_linestatus) FROM {every}"),
        ("Column", "l_linestatus", "Histogram.bins", f"SELECT count(DISTINCT l_linestatus) FROM {every}"),
    ]
    for kind in DataType.CLASSES:
        count = f"count(*) FILTER (WHERE {'TRUE' if kind == 'String' else 'FALSE'})"
        rows.append(("Column", "l_returnflag", f"DataType.abs.{kind}", f"SELECT {count} FROM {every}"))
        rows.append(("Column", "l_returnflag", f"DataType.ratio.{kind}", f"SELECT {count} / count(*) FROM {every}"))
    bins = f"SELECT l_linestatus AS v, count(*) AS c, sum(count(*)) OVER () AS n FROM {every} GROUP BY 1"
    return (
        expected(rows, 4)
        + f" UNION ALL SELECT 'Column', 'l_linestatus', 'Histogram.abs.' || v, CAST(c AS DOUBLE) FROM ({bins})"
        + f" UNION ALL SELECT 'Column', 'l_linestatus', 'Histogram.ratio.' || v, round(c / n, 4) FROM ({bins})"
    )


QUERIES = {"full_analysis": Query(full_analysis, _sql())}

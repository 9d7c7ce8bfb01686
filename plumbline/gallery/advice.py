"""Constraint suggestions, rule by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.gallery.base import ORDERS, Derived, Query, table
from plumbline.plans import suggestions as S

# A tail of rare values below 5 %: 95 of 100 rows hold one of three values.
ORDERS_TAILED = Derived(
    "orders",
    {
        "priority": "nullif(o_orderpriority, '1-URGENT')",
        "number_text": "concat('-9000000000000000', cast(cast(o_totalprice AS bigint) AS STRING))",
        "price_text": "concat(cast(o_orderkey AS STRING), '.5')",
        "tailed": "CASE WHEN o_orderkey <= 40 THEN concat('rare', cast(o_orderkey AS STRING)) "
        "ELSE concat('common', cast(o_orderkey % 3 AS STRING)) END",
    },
)


def _rule(rule: S.Rule, frame: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        runner = S.ConstraintSuggestionRunner(spark).onData(frame(spark, folder))
        found = runner.addConstraintRule(rule).run().as_frame()
        return found.select(
            "column_name", "rule", "constraint", "sql_predicate", F.round("current_value", 6).alias("current_value")
        )

    return run


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return ORDERS_TAILED.frame(spark, folder)


def _customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer")


def _union(columns: list[str], row: str) -> str:
    return " UNION ALL ".join(row.format(c=column) for column in columns)


SUGGESTED = (
    "SELECT '{c}' AS column_name, '%s' AS rule, %s AS \"constraint\", %s AS sql_predicate, "
    "round(CAST(%s AS DOUBLE), 6) AS current_value FROM %s"
)
ORDERS_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
    "priority",
    "number_text",
    "price_text",
    "tailed",
]
ORDERS_TEXTS = ["o_orderstatus", "o_orderpriority", "priority", "number_text", "price_text", "tailed"]

COMPLETE = _union(
    ORDERS_COLUMNS,
    SUGGESTED % ("CompleteIfComplete", "'.isComplete(''{c}'')'", "'`{c}` IS NOT NULL'", "1", ORDERS_TAILED.sql)
    + " HAVING count({c}) = count(*)",
)
BOUND = "floor((c - 1.96 * sqrt(c * (1 - c) / n)) * 100) / 100"
RETAIN = _union(
    ORDERS_COLUMNS,
    SUGGESTED
    % (
        "RetainCompleteness",
        f"'.hasCompleteness(''{{c}}'', ''value >= ' || CAST({BOUND} AS VARCHAR) || ''')'",
        "'`{c}` IS NOT NULL'",
        "c",
        f"(SELECT count({{c}}) / count(*) AS c, count(*) AS n FROM {ORDERS_TAILED.sql})",
    )
    + " WHERE c > 0.2 AND c < 1",
)


def _all(column: str, pattern: str) -> str:
    return f"count(*) FILTER (WHERE regexp_matches({column}, '{pattern}')) = count({column})"


TYPES = (
    f"(SELECT CASE WHEN {_all('{c}', patterns.INTEGRAL)} THEN 'Integral' "
    f"WHEN {_all('{c}', patterns.INTEGRAL + '|' + patterns.FRACTIONAL)} THEN 'Fractional' "
    f"WHEN {_all('{c}', '^(true|false)$')} THEN 'Boolean' END AS kind FROM {ORDERS_TAILED.sql})"
)


TWICE = "'" * 2


def _types() -> str:
    rows = []
    for column in ORDERS_TEXTS:
        source = TYPES.replace("{c}", column)
        rows.append(
            f"SELECT '{column}' AS column_name, 'RetainType' AS rule, "
            f"'.hasDataType(''{column}'', ''' || kind || ''')' AS \"constraint\", "
            f"'`{column}` IS NULL OR `{column}` ' || CASE kind "
            f"WHEN 'Integral' THEN 'RLIKE r{TWICE}{patterns.INTEGRAL}{TWICE}' "
            f"WHEN 'Fractional' THEN 'RLIKE r{TWICE}{patterns.INTEGRAL}|{patterns.FRACTIONAL}{TWICE}' "
            f"ELSE 'IN ({TWICE}true{TWICE}, {TWICE}false{TWICE})' END AS sql_predicate, "
            f"1.0::DOUBLE AS current_value FROM {source} WHERE kind IS NOT NULL"
        )
    return " UNION ALL ".join(rows)


def _categories(column: str) -> str:
    """Value counts of a column with what both range rules look at."""
    return (
        f"WITH f AS (SELECT {column} AS v, count(*) AS c FROM {ORDERS_TAILED.sql} "
        f"WHERE {column} IS NOT NULL GROUP BY 1), "
        "r AS (SELECT v, c, sum(c) OVER (ORDER BY c DESC, v) - c < 0.9 * sum(c) OVER () AS top, "
        f"sum(c) OVER () AS present, (SELECT count(*) FROM {ORDERS_TAILED.sql}) AS n FROM f), "
        "s AS (SELECT count(*) FILTER (WHERE c = 1) / count(*) AS once, "
        "count(*) FILTER (WHERE top AND c = 1) / count(*) FILTER (WHERE top) AS top_once, "
        "sum(c) FILTER (WHERE top) / any_value(present) AS share, any_value(n) AS n, any_value(present) AS present, "
        "string_agg('''' || v || '''', ', ' ORDER BY v) AS texts, "
        "string_agg('''' || v || '''', ', ' ORDER BY v) FILTER (WHERE top) AS top_texts FROM r HAVING count(*) <= 100)"
    )


def _ranges(fractional: bool) -> str:
    rows = []
    for column in ORDERS_TEXTS:
        texts, rule = ("top_texts", "FractionalCategoricalRange") if fractional else ("texts", "CategoricalRange")
        condition = "once > 0.1 AND top_once <= 0.1" if fractional else "once <= 0.1"
        bound = "floor((p - 1.96 * sqrt(p * (1 - p) / n)) * 100) / 100"
        tail = f"|| '], ''value >= ' || CAST({bound} AS VARCHAR) || ''')'" if fractional else "|| '])'"
        rows.append(
            f"SELECT * FROM ({_categories(column)} SELECT '{column}' AS column_name, '{rule}' AS rule, "
            f"'.isContainedIn(''{column}'', [' || {texts} {tail} AS \"constraint\", "
            f"'`{column}` IS NULL OR `{column}` IN (' || {texts} || ')' AS sql_predicate, "
            f"round({'share' if fractional else '1.0::DOUBLE'}, 6) AS current_value "
            f"FROM (SELECT *, (n - present + share * present) / n AS p FROM s) WHERE {condition})"
        )
    return " UNION ALL ".join(rows)


NON_NEGATIVE = _union(
    ["c_custkey", "c_nationkey", "c_acctbal"],
    SUGGESTED
    % (
        "NonNegativeNumbers",
        "'.isNonNegative(''{c}'')'",
        "'`{c}` IS NULL OR `{c}` >= 0'",
        "min({c})",
        "customer",
    )
    + " HAVING min({c}) >= 0",
)
UNIQUE = _union(
    ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    SUGGESTED
    % (
        "UniqueIfUnique",
        "'.isUnique(''{c}'')'",
        "'count(*) OVER (PARTITION BY `{c}`) = 1'",
        "1",
        "customer",
    )
    + " HAVING count(DISTINCT {c}) = count(*)",
)


def suggestions_head(spark: SparkSession, folder: str) -> DataFrame:
    """All rules over a table; the first five suggestions by column and rule, as records."""
    runner = S.ConstraintSuggestionRunner(spark).onData(table(spark, folder, "customer"))
    found = runner.addConstraintRule(S.DEFAULT()).run()
    records = found.as_json().withColumnRenamed("record", "json")
    first = found.head(5).select("column_name", "rule")
    return first.join(records, ["column_name", "rule"]).select(
        "column_name", "rule", F.get_json_object("json", "$.constraint").alias("constraint")
    )


HEAD = """
SELECT * FROM (
  SELECT 'c_acctbal' AS column_name, 'CompleteIfComplete' AS rule, '.isComplete(''c_acctbal'')' AS "constraint"
  FROM customer HAVING count(c_acctbal) = count(*)
  UNION ALL SELECT 'c_acctbal', 'NonNegativeNumbers', '.isNonNegative(''c_acctbal'')'
  FROM customer HAVING min(c_acctbal) >= 0
  UNION ALL SELECT 'c_acctbal', 'UniqueIfUnique', '.isUnique(''c_acctbal'')'
  FROM customer HAVING count(DISTINCT c_acctbal) = count(*)
  UNION ALL SELECT 'c_custkey', 'CompleteIfComplete', '.isComplete(''c_custkey'')'
  FROM customer HAVING count(c_custkey) = count(*)
  UNION ALL SELECT 'c_custkey', 'NonNegativeNumbers', '.isNonNegative(''c_custkey'')'
  FROM customer HAVING min(c_custkey) >= 0
  UNION ALL SELECT 'c_custkey', 'UniqueIfUnique', '.isUnique(''c_custkey'')'
  FROM customer HAVING count(DISTINCT c_custkey) = count(*)
  UNION ALL SELECT 'c_mktsegment', 'CategoricalRange', '.isContainedIn(''c_mktsegment'', ['
    || (SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) || '])'
  FROM customer HAVING count(DISTINCT c_mktsegment) <= 100
  UNION ALL SELECT 'c_mktsegment', 'CompleteIfComplete', '.isComplete(''c_mktsegment'')'
  FROM customer HAVING count(c_mktsegment) = count(*)
  UNION ALL SELECT 'c_name', 'CompleteIfComplete', '.isComplete(''c_name'')'
  FROM customer HAVING count(c_name) = count(*))
ORDER BY column_name, rule LIMIT 5
"""


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules see: one row per column."""
    return S.profile_frame(ORDERS.frame(spark, folder)).select(
        "column_name",
        "data_type",
        "size",
        F.round("completeness", 6).alias("completeness"),
        "minimum",
        "maximum",
        F.round("mean", 4).alias("mean"),
        F.round("deviation", 4).alias("deviation"),
    )


def _profile_sql() -> str:
    types = {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
        "priority": "string",
    }
    rows = []
    for column, kind in types.items():
        number = f"CAST({column} AS DOUBLE)" if kind in ("bigint", "double") else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) AS size, "
            f"round(count({column}) / count(*), 6) AS completeness, min({number}) AS minimum, "
            f"max({number}) AS maximum, round(avg({number}), 4) AS mean, "
            f"round(stddev_pop({number}), 4) AS deviation FROM {ORDERS.sql}"
        )
    return " UNION ALL ".join(rows)


QUERIES = {
    "suggest_complete": Query(_rule(S.complete_if_complete, _orders), COMPLETE),
    "suggest_retain_completeness": Query(_rule(S.retain_completeness, _orders), RETAIN),
    "suggest_retain_type": Query(_rule(S.retain_type, _orders), _types()),
    "suggest_categorical": Query(_rule(S.categorical_range, _orders), _ranges(False)),
    "suggest_fractional_categorical": Query(_rule(S.fractional_categorical_range, _orders), _ranges(True)),
    "suggest_non_negative": Query(_rule(S.non_negative_numbers, _customer), NON_NEGATIVE),
    "suggest_unique": Query(_rule(S.unique_if_unique, _customer), UNIQUE),
    "suggestions_head": Query(suggestions_head, HEAD),
    "column_profile": Query(column_profile, _profile_sql()),
}

"""Checks and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions import patterns
from plumbline.gallery.base import ORDERS, Derived, Query, expected, rounded, table
from plumbline.operators.metrics import Size
from plumbline.plans.checks import Against, Check, CheckLevel, close_to
from plumbline.plans.verification import VerificationResult, VerificationSuite, Verified
from plumbline.sources.frames import value_set

LEVEL = CheckLevel.Error

# Outcomes of one constraint: check, level, constraint, condition for success, message on failure.
Ruling = tuple[str, str, str, str, str]


def outcomes_sql(rulings: list[Ruling]) -> str:
    """SQL for check results; conditions and messages are queries for one value."""
    rows = " UNION ALL ".join(
        f"SELECT '{check}' AS check_name, '{level}' AS level, '{constraint}' AS text, "
        f"({condition}) AS ok, ({message}) AS message"
        for check, level, constraint, condition, message in rulings
    )
    return (
        'SELECT check_name AS "check", level AS check_level, '
        "CASE WHEN bool_and(ok) OVER (PARTITION BY check_name) THEN 'Success' ELSE level END "
        'AS check_status, text AS "constraint", '
        "CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS constraint_status, "
        f"CASE WHEN ok THEN '' ELSE message END AS constraint_message FROM ({rows})"
    )


def _message(value: str, hint: str = "") -> str:
    tail = f": {hint}" if hint else ""
    return f"SELECT 'value ' || CAST(CAST({value} AS DOUBLE) AS VARCHAR) || ' does not meet the constraint{tail}'"


def verified(df: DataFrame, *checks: Check) -> Verified:
    suite = VerificationSuite(df.sparkSession).onData(df)
    for check in checks:
        suite.addCheck(check)
    return suite.run()


def results(df: DataFrame, *checks: Check, messages: bool = True) -> DataFrame:
    frame = VerificationResult.checkResultsAsDataFrame(df.sparkSession, verified(df, *checks))
    return frame if messages else frame.drop("constraint_message")


def _without_messages(sql: str) -> str:
    return f"SELECT * EXCLUDE (constraint_message) FROM ({sql})"


def check_has_size(spark: SparkSession, folder: str) -> DataFrame:
    check = (
        Check(spark, LEVEL, "size")
        .hasSize(lambda n: n >= 1000)
        .hasSize("value >= 1000 AND value % 2 = 1", "an odd number is wanted")
    )
    return results(table(spark, folder, "orders"), check)


N_ORDERS = "SELECT count(*) FROM orders"
CHECK_HAS_SIZE = outcomes_sql(
    [
        ("size", "Error", "hasSize()", f"SELECT count(*) >= 1000 FROM orders", "''"),
        (
            "size",
            "Error",
            "hasSize()",
            "SELECT count(*) >= 1000 AND count(*) % 2 = 1 FROM orders",
            _message(f"({N_ORDERS})", "an odd number is wanted"),
        ),
    ]
)


def check_has_completeness(spark: SparkSession, folder: str) -> DataFrame:
    check = (
        Check(spark, LEVEL, "completeness")
        .hasCompleteness("priority", lambda share: share > 0.5)
        .hasCompleteness("priority", lambda share: share > 0.95, "too many are urgent")
        .hasCompleteness("o_custkey", close_to(1.0))
    )
    return results(ORDERS.frame(spark, folder), check, messages=False)


def _share(condition: str, source: str) -> str:
    return f"SELECT count(*) FILTER (WHERE {condition}) / count(*) FROM {source}"


def check_is_complete(spark: SparkSession, folder: str) -> DataFrame:
    check = Check(spark, LEVEL, "complete").isComplete("o_orderkey").isComplete("priority", "unset")
    return results(ORDERS.frame(spark, folder), check, messages=False)


def check_is_contained_in(spark: SparkSession, folder: str) -> DataFrame:
    """NULL passes; numbers compare by their text."""
    check = (
        Check(spark, LEVEL, "contained")
        .isContainedIn("o_orderstatus", ["F", "O", "P"])
        .isContainedIn("o_orderstatus", ["F", "O"])
        .isContainedIn("priority", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
        .isContainedIn("o_custkey", [1, 2, 3], lambda share: share < 0.5)
    )
    return results(ORDERS.frame(spark, folder), check, messages=False)


def contained_in_table(spark: SparkSession, folder: str) -> DataFrame:
    """The allowed values come from other tables, and stay in them."""
    supplier = table(spark, folder, "supplier")
    solvent = value_set(supplier.filter("s_acctbal > 0"), "s_suppkey")
    check = (
        Check(spark, LEVEL, "suppliers")
        .isContainedIn("l_suppkey", value_set(supplier, "s_suppkey"))
        .isContainedIn("l_suppkey", solvent)
        .isContainedIn("l_suppkey", solvent, "value > 0.5")
    )
    found = verified(table(spark, folder, "lineitem"), check)
    metrics = rounded(VerificationResult.successMetricsAsDataFrame(spark, found))
    statuses = VerificationResult.checkResultsAsDataFrame(spark, found).selectExpr(
        "'Check' AS entity",
        "constraint AS instance",
        "constraint_status AS name",
        "cast(NULL AS double) AS value",
    )
    return metrics.union(statuses)


SOLVENT = (
    "SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey{})) "
    "/ count(*) AS share FROM lineitem"
)
CONTAINED_IN_TABLE = (
    expected(
        [
            ("Column", "l_suppkey contained in s_suppkey", "Compliance", SOLVENT.format(condition))
            for condition in ("", " AND s_acctbal > 0")
        ]
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        "SELECT 'Check', 'isContainedIn(l_suppkey, s_suppkey)', "
        f"CASE WHEN share {bound} THEN 'Success' ELSE 'Failure' END, CAST(NULL AS DOUBLE) "
        f"FROM ({SOLVENT.format(condition)})"
        for condition, bound in (("", "= 1"), (" AND s_acctbal > 0", "= 1"), (" AND s_acctbal > 0", "> 0.5"))
    )
)

EMAILS = Derived(
    "customer",
    {
        "mail": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(c_name, '@', c_mktsegment, '.example') END",
        "mixed_mail": "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat('u', c_custkey, '@a.org') END",
        "good_mail": "concat('u', c_custkey, '@a.org')",
    },
)


def contains_email(spark: SparkSession, folder: str) -> DataFrame:
    check = (
        Check(spark, LEVEL, "mail")
        .containsEmail("good_mail")
        .containsEmail("mail")
        .containsEmail("mixed_mail", lambda share: share >= 0.5)
    )
    found = verified(EMAILS.frame(spark, folder), check)
    return _with_statuses(spark, found)


def contains_email_text(spark: SparkSession, folder: str) -> DataFrame:
    """Mail addresses anywhere in whole documents."""
    check = Check(spark, CheckLevel.Warning, "documents").containsEmail("text", lambda share: share < 0.001)
    return _with_statuses(spark, verified(table(spark, folder, "documents"), check))


def _with_statuses(spark: SparkSession, found: Verified) -> DataFrame:
    metrics = rounded(VerificationResult.successMetricsAsDataFrame(spark, found))
    statuses = VerificationResult.checkResultsAsDataFrame(spark, found).selectExpr(
        "check_status AS entity",
        "constraint AS instance",
        "constraint_status AS name",
        "cast(NULL AS double) AS value",
    )
    return metrics.union(statuses)


def _pattern_sql(source: str, pattern: str, kind: str, level: str, bounds: dict[str, str]) -> str:
    """Metric rows and statuses of pattern constraints with these bounds on columns."""
    match = {column: f"count(*) FILTER (WHERE regexp_matches({column}, '{pattern}')) / count(*)" for column in bounds}
    metrics = expected(
        ("Column", column, "PatternMatch", f"SELECT {share} FROM {source}") for column, share in match.items()
    )
    passed = {column: f"(SELECT {match[column]} {bound} FROM {source})" for column, bound in bounds.items()}
    overall = f"CASE WHEN {' AND '.join(passed.values())} THEN 'Success' ELSE '{level}' END"
    statuses = " UNION ALL ".join(
        f"SELECT {overall}, '{kind}({column})', CASE WHEN {ok} THEN 'Success' ELSE 'Failure' END, "
        "CAST(NULL AS DOUBLE)"
        for column, ok in passed.items()
    )
    return f"{metrics} UNION ALL {statuses}"


NUMBERS = Derived(
    "customer",
    {
        "ssn": "concat(lpad(cast(c_custkey % 1000 AS STRING), 3, '0'), '-', "
        "lpad(cast(c_custkey % 100 AS STRING), 2, '0'), '-', "
        "lpad(cast(c_custkey * 7 % 10000 AS STRING), 4, '0'))",
        "good_ssn": "concat('123-45-', lpad(cast(c_custkey % 9000 + 1 AS STRING), 4, '0'))",
    },
)


def contains_ssn(spark: SparkSession, folder: str) -> DataFrame:
    check = (
        Check(spark, LEVEL, "numbers")
        .containsSocialSecurityNumber("good_ssn")
        .containsSocialSecurityNumber("ssn", lambda share: share > 0.99)
    )
    return _with_statuses(spark, verified(NUMBERS.frame(spark, folder), check))


def check_is_unique(spark: SparkSession, folder: str) -> DataFrame:
    check = (
        Check(spark, LEVEL, "unique")
        .isUnique("o_orderkey")
        .isUnique("o_custkey", "customers order more than once")
        .isUnique("priority")
    )
    return results(ORDERS.frame(spark, folder), check, messages=False)


def _unique(column: str) -> str:
    return (
        f"SELECT count(*) FILTER (WHERE c = 1) = sum(c) FROM (SELECT count(*) AS c FROM {ORDERS.sql} "
        f"WHERE {column} IS NOT NULL GROUP BY {column})"
    )


def check_dynamic_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds that are themselves counted from the data, in the same run."""
    dear = Size("o_totalprice > 100000 AND o_orderstatus = 'F'")
    check = (
        Check(spark, LEVEL, "dynamic")
        .hasSize(Against(lambda n, part: n >= 4 * part, dear))
        .hasSize(Against(lambda n, part: n >= 2 * part, dear))
        .hasCompleteness("priority", Against(lambda share, part, n: share > part / n, dear, Size()))
    )
    return results(ORDERS.frame(spark, folder), check, messages=False)


DEAR = "count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F')"
DYNAMIC = _without_messages(
    outcomes_sql(
        [
            ("dynamic", "Error", "hasSize()", f"SELECT count(*) >= 4 * {DEAR} FROM orders", "''"),
            ("dynamic", "Error", "hasSize()", f"SELECT count(*) >= 2 * {DEAR} FROM orders", "''"),
            (
                "dynamic",
                "Error",
                "hasCompleteness(priority)",
                f"SELECT count(priority) / count(*) > {DEAR} / count(*) FROM {ORDERS.sql}",
                "''",
            ),
        ]
    )
)


def _suite(spark: SparkSession, folder: str) -> Verified:
    statuses = value_set(table(spark, folder, "orders"), "o_orderstatus")
    review = (
        Check(spark, CheckLevel.Error, "orders gate")
        .hasSize(lambda n: n >= 1000)
        .isComplete("o_orderkey")
        .isComplete("priority", "customers are needed")
        .isContainedIn("o_orderstatus", statuses)
        .isUnique("o_orderkey")
    )
    watch = (
        Check(spark, CheckLevel.Warning, "Watch")
        .hasCompleteness("priority", "value > 0.5")
        .isContainedIn("o_orderstatus", ["F", "O", "P"])
    )
    return verified(ORDERS.frame(spark, folder), review, watch)


def verification_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Two checks in one run: one fails at its level, the other passes."""
    frame = VerificationResult.checkResultsAsDataFrame(spark, _suite(spark, folder))
    return frame.drop("constraint_message")


def verification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(VerificationResult.successMetricsAsDataFrame(spark, _suite(spark, folder)))


IN_STATUSES = _share("o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O', 'P')", "orders")
COMPLETE = _share("priority IS NOT NULL", ORDERS.sql)
SUITE = _without_messages(
    outcomes_sql(
        [
            ("orders gate", "Error", "hasSize()", "SELECT count(*) >= 1000 FROM orders", "''"),
            ("orders gate", "Error", "isComplete(o_orderkey)", "SELECT count(o_orderkey) = count(*) FROM orders", "''"),
            ("orders gate", "Error", "isComplete(priority)", f"({COMPLETE}) = 1", "''"),
            ("orders gate", "Error", "isContainedIn(o_orderstatus, o_orderstatus)", "TRUE", "''"),
            ("orders gate", "Error", "isUnique(o_orderkey)", _unique("o_orderkey"), "''"),
            ("Watch", "Warning", "hasCompleteness(priority)", f"({COMPLETE}) > 0.5", "''"),
            ("Watch", "Warning", "isContainedIn(o_orderstatus, [F,O,P])", f"({IN_STATUSES}) = 1", "''"),
        ]
    )
)
SUITE_METRICS = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM orders"),
        ("Column", "o_orderkey", "Completeness", "SELECT count(o_orderkey) / count(*) FROM orders"),
        ("Column", "priority", "Completeness", COMPLETE),
        ("Column", "o_orderstatus contained in o_orderstatus", "Compliance", "1.0"),
        (
            "Column",
            "o_orderkey",
            "Uniqueness",
            "SELECT count(*) FILTER (WHERE c = 1) / sum(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)",
        ),
        ("Column", "o_orderstatus contained in F,O,P", "Compliance", IN_STATUSES),
    ]
)


def _rulings(check: str, outcomes: dict[str, str]) -> str:
    return _without_messages(
        outcomes_sql([(check, "Error", text.split("#")[0], ok, "''") for text, ok in outcomes.items()])
    )


QUERIES: dict[str, Query] = {
    "check_has_size": Query(check_has_size, CHECK_HAS_SIZE),
    "check_has_completeness": Query(
        check_has_completeness,
        _rulings(
            "completeness",
            {
                "hasCompleteness(priority)": f"({COMPLETE}) > 0.5",
                "hasCompleteness(priority)#2": f"({COMPLETE}) > 0.95",
                "hasCompleteness(o_custkey)": "SELECT count(o_custkey) = count(*) FROM orders",
            },
        ),
    ),
    "check_is_complete": Query(
        check_is_complete,
        _rulings(
            "complete",
            {
                "isComplete(o_orderkey)": "SELECT count(o_orderkey) = count(*) FROM orders",
                "isComplete(priority)": f"({COMPLETE}) = 1",
            },
        ),
    ),
    "check_is_contained_in": Query(
        check_is_contained_in,
        _rulings(
            "contained",
            {
                "isContainedIn(o_orderstatus, [F,O,P])": f"({IN_STATUSES}) = 1",
                "isContainedIn(o_orderstatus, [F,O])": f"({_share('''o_orderstatus IN ('F', 'O')''', 'orders')}) = 1",
                "isContainedIn(priority, [2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW])": "SELECT count(*) = 0 FROM "
                f"{ORDERS.sql} WHERE priority NOT IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')",
                "isContainedIn(o_custkey, [1,2,3])": f"({_share('o_custkey IN (1, 2, 3)', 'orders')}) < 0.5",
            },
        ),
    ),
    "contained_in_table": Query(contained_in_table, CONTAINED_IN_TABLE),
    "contains_email": Query(
        contains_email,
        _pattern_sql(
            EMAILS.sql,
            patterns.EMAIL,
            "containsEmail",
            "Error",
            {"good_mail": "= 1", "mail": "= 1", "mixed_mail": ">= 0.5"},
        ),
    ),
    "contains_email_text": Query(
        contains_email_text,
        _pattern_sql("documents", patterns.EMAIL, "containsEmail", "Warning", {"text": "< 0.001"}),
    ),
    "contains_ssn": Query(
        contains_ssn,
        _pattern_sql(
            NUMBERS.sql,
            patterns.SOCIAL_SECURITY_NUMBER,
            "containsSocialSecurityNumber",
            "Error",
            {"good_ssn": "= 1", "ssn": "> 0.99"},
        ),
    ),
    "check_is_unique": Query(
        check_is_unique,
        _rulings(
            "unique",
            {
                "isUnique(o_orderkey)": _unique("o_orderkey"),
                "isUnique(o_custkey)": _unique("o_custkey"),
                "isUnique(priority)": _unique("priority"),
            },
        ),
    ),
    "check_dynamic_threshold": Query(check_dynamic_threshold, DYNAMIC),
    "verification_suite": Query(verification_suite, SUITE),
    "verification_metrics": Query(verification_metrics, SUITE_METRICS),
}

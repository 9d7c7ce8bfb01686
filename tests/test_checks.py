"""Constraints that pass and fail on purpose, levels and statuses."""

import json
from datetime import date

import employees
import pytest

from plumbline import (
    Against,
    Check,
    CheckLevel,
    ConstraintSuggestionRunner,
    DEFAULT,
    Size,
    VerificationResult,
    VerificationSuite,
    close_to,
)
from plumbline.functions.columns import cast_columns


@pytest.fixture(scope="module")
def staff(spark):
    return cast_columns(employees.frame(spark), {"Pay": "double", "First month": "int"})


def outcome(df, build):
    check = build(Check(df.sparkSession, CheckLevel.Error, "c"))
    result = VerificationSuite(df.sparkSession).onData(df).addCheck(check).run()
    rows = VerificationResult.checkResultsAsDataFrame(df.sparkSession, result).collect()
    return [(row.constraint_status, row.constraint_message) for row in rows]


def passes(df, build):
    return [status == "Success" for status, _ in outcome(df, build)]


@pytest.mark.parametrize(
    "good,bad",
    [
        (lambda c: c.hasSize(lambda n: n == 10), lambda c: c.hasSize(lambda n: n > 10)),
        (lambda c: c.hasSize("value = 10"), lambda c: c.hasSize("value > 10")),
        (lambda c: c.hasCompleteness("Badge", close_to(0.9)), lambda c: c.hasCompleteness("Badge", close_to(1.0))),
        (lambda c: c.isComplete("Years here (full)"), lambda c: c.isComplete("Badge")),
        (lambda c: c.isContainedIn("First month", list(range(1, 14))),
         lambda c: c.isContainedIn("First month", range(1, 13))),
        (lambda c: c.containsEmail("Mail to", "value = 0.8"), lambda c: c.containsEmail("Mail to")),
        (lambda c: c.containsSocialSecurityNumber("Tax id", "value = 0.4"),
         lambda c: c.containsSocialSecurityNumber("Tax id")),
        (lambda c: c.isUnique("Tax id"), lambda c: c.isUnique("Badge")),
        (lambda c: c.isNonNegative("Pay"), lambda c: c.isNonNegative("Negative")),
        (lambda c: c.hasDataType("First year", "Integral"), lambda c: c.hasDataType("Called", "Integral")),
    ],
)
def test_each_constraint_can_pass_and_fail(staff, good, bad):
    df = staff.selectExpr("*", "-Pay AS Negative").drop("Years here (full)").selectExpr(
        "*", "1 AS `Years here (full)`"
    )
    assert all(passes(df, good))
    assert not any(passes(df, bad))


def test_allowed_values_of_any_type(spark):
    df = spark.sql("SELECT true AS b, date'2024-01-02' AS d, 1.5D AS x UNION ALL SELECT NULL, NULL, 2D")
    good = lambda c: c.isContainedIn("b", [True]).isContainedIn("d", [date(2024, 1, 2)]).isContainedIn("x", [1.5, 2.0])
    assert passes(df, good) == [True] * 3
    assert passes(df, lambda c: c.isContainedIn("b", [False]).isContainedIn("x", [None])) == [False] * 2


def test_allowed_values_from_a_table(spark, staff):
    months = spark.range(1, 14).selectExpr("id AS months_val")
    assert passes(staff, lambda c: c.isContainedIn("First month", months)) == [True]
    assert passes(staff, lambda c: c.isContainedIn("First month", months.filter("months_val <> 9"))) == [False]


def test_hint_and_value_in_the_message(staff):
    found = outcome(staff, lambda c: c.hasSize(lambda n: n > 10, "too small").isComplete("Nope", "gone"))
    assert found == [
        ("Failure", "value 10.0 does not meet the constraint: too small"),
        ("Failure", "MissingColumn, no column named 'Nope': gone"),
    ]


def test_bounds_from_data(staff):
    rich = Size("Pay > 100000")
    share = lambda value, part, n: abs(value - part / n) < 1e-9
    assert passes(
        staff,
        lambda c: c.hasSize(Against(lambda n, part: n >= 2 * part, rich))
        .hasSize(Against(lambda n, part: n >= 3 * part, rich))
        .hasCompleteness("Badge", Against(share, rich, Size())),
    ) == [True, False, False]


def test_an_assertion_that_raises_fails_its_constraint(staff):
    found = outcome(staff, lambda c: c.hasSize(lambda n: n / 0 > 1).hasSize("value > 1"))
    assert found == [("Failure", "the assertion raised ZeroDivisionError"), ("Success", "")]


def test_faulty_sql_assertions_fail_their_constraints_only(staff):
    found = outcome(
        staff,
        lambda c: c.hasSize("value = 10")
        .hasSize("valu = 10")
        .hasSize("value + 1")
        .hasSize("value / (value - 10) > 1")
        .hasSize("value > 10")
        .hasSize("value = 10"),
    )
    assert [status for status, _ in found] == ["Success", *["Failure"] * 4, "Success"]
    assert found[1][1].startswith("the assertion raised UNRESOLVED_COLUMN")
    assert "DIVIDE_BY_ZERO" in found[3][1]


def test_levels_and_status(spark, staff):
    failing = Check(spark, CheckLevel.Warning, "w").hasSize("value > 100").hasSize("value > 1")
    passing = Check(spark, CheckLevel.Error, "e").hasSize("value > 1")
    result = VerificationSuite(spark).onData(staff).addCheck(failing).addCheck(passing).run()
    rows = VerificationResult.checkResultsAsDataFrame(spark, result).collect()
    assert [(row.check, row.check_level, row.check_status) for row in rows] == [
        ("w", "Warning", "Warning"),
        ("w", "Warning", "Warning"),
        ("e", "Error", "Success"),
    ]
    assert result.status == "Warning"
    assert VerificationResult.successMetricsAsDataFrame(spark, result).collect()[0].value == 10


def test_suggestions_hold_on_their_data(spark, staff):
    """Whatever is suggested as a row predicate is true of every row it was found on."""
    df = staff.union(staff).union(staff.filter("`Badge` = '1'"))
    found = ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(DEFAULT()).run()
    assert found.found
    for one in found.found:
        if one.rule in ("CompleteIfComplete", "RetainType", "CategoricalRange", "NonNegativeNumbers"):
            assert df.filter(f"NOT ({one.sql_predicate})").isEmpty(), one
    assert not any(one.rule == "UniqueIfUnique" for one in found.found)
    assert found.head().count() == 5
    assert {"column_name", "rule", "record"} == set(found.as_json().columns)
    records = json.loads(json.dumps(found.as_dict()))["constraint_suggestions"]
    assert len(records) == len(found.found) == found.as_frame().count()


def test_suggestions_on_text_with_quotes(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), ("it's",), ("a\\b",), (None,)], "t string")
    found = ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(DEFAULT()).run().found
    assert {one.rule for one in found} == {"CategoricalRange", "RetainCompleteness"}
    predicate = next(one.sql_predicate for one in found if one.rule == "CategoricalRange")
    assert df.filter(predicate).count() == 5


def test_no_suggestions_without_rows(spark):
    df = spark.createDataFrame([], "a int, t string")
    assert ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(DEFAULT()).run().found == []

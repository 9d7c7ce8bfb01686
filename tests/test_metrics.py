"""Metrics on small tables whose values are known by hand."""

import math
import random
from collections import Counter

import employees
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import (
    AnalysisRunner,
    AnalyzerContext,
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    ContainedInTable,
    Correlation,
    CountDistinct,
    DataType,
    Distinctness,
    Entropy,
    Histogram,
    Maximum,
    MaxLength,
    Mean,
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
from plumbline.functions.columns import cast_columns, rename_columns
from plumbline.operators import quantiles
from plumbline.sources.frames import schema_frame

CASTS = {
    "Pay": "double",
    "First day": "int",
    "Years here (full)": "int",
    "Parking lot": "double",
    "Years of age": "double",
    "First month": "int",
    "Desk (ext)": "int",
}
NAMES = {"Parking lot.": "Parking lot", "Years of age.": "Years of age", "Desk (ext). ": "Desk (ext)"}


@pytest.fixture(scope="module")
def staff(spark):
    return cast_columns(rename_columns(employees.frame(spark), NAMES), CASTS)


def run(df, *metrics):
    return AnalysisRunner(df.sparkSession).onData(df).addAnalyzers(metrics).run()


def value(df, metric):
    return run(df, metric).value(metric)


def named(result):
    """All values of a run by their names, the bins of histograms among them."""
    return {row["name"]: row["value"] for row in result.success_frame().collect()}


def test_bad_casts_become_null(staff):
    assert value(staff, Completeness("Desk (ext)")) == 0.8
    assert value(staff, Completeness("First day")) == 0.8
    assert value(staff, Completeness("Pay")) == 0.8
    types = {row["column"]: row["type"] for row in schema_frame(staff).collect()}
    assert types["Pay"] == "double" and types["Desk (ext)"] == "int" and types["Badge"] == "string"


def test_extremes_and_moments_of_some_rows(staff):
    rich = "Pay > 100000"
    kept = [120000.5, 150000, 101000, 200000]
    assert value(staff, Sum("Pay", rich)) == sum(kept) and value(staff, Size(rich)) == 4
    assert value(staff, Mean("Pay", rich)) == pytest.approx(sum(kept) / 4)
    assert (value(staff, Minimum("Pay", rich)), value(staff, Maximum("Pay", rich))) == (101000, 200000)
    spread = math.sqrt(sum((x - sum(kept) / 4) ** 2 for x in kept) / 4)
    assert value(staff, StandardDeviation("Pay", rich)) == pytest.approx(spread)
    assert (value(staff, MinLength("Mail to", rich)), value(staff, MaxLength("Mail to", rich))) == (10, 12)


def test_shares_and_their_labels(staff):
    labelled = Compliance("enough", "Pay >= 55000 AND `First year` IS NOT NULL")
    assert value(staff, labelled) == 0.6 and labelled.instance == "enough"
    assert value(staff, PatternMatch("Tax id", "[0-9]{3}-[0-9]{2}", where="Pay > 100000")) == 0.75


def test_exact_and_estimated_ranks(staff):
    assert run(staff, ApproxQuantiles("Pay", [0.5, 0.95], 0.0)).parts(
        ApproxQuantiles("Pay", [0.5, 0.95], 0.0), "ApproxQuantiles-"
    ) == {"0.5": 99999.5, "0.95": 200000}
    assert value(staff, ApproxQuantile("Pay", 0.9, 0.2, "Pay > 100000")) in (150000, 200000)
    assert value(staff, ApproxCountDistinct("Called")) == 9


def test_one_column_tells_about_another(staff):
    pairs = [(30.5, 60), (41, 81.5), (52, 70), (23, 55), (23, 90), (35, 64), (61, 77), (44, 58), (29, 66)]
    ab, a, b = Counter(pairs), Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    n = len(pairs)
    direct = sum(c / n * math.log(c * n / (a[x] * b[y])) for (x, y), c in ab.items())
    assert value(staff, MutualInformation(["Years of age", "Parking lot"])) == pytest.approx(direct)
    assert value(staff, Correlation("Years of age", "Years of age")) == pytest.approx(1.0)


def test_results_as_a_frame(staff):
    result = run(staff, DataType("Badge"), Entropy("Tax id", "Pay > 100000"), Distinctness(["Badge", "Called"]))
    assert not result.failures
    frame = AnalyzerContext.successMetricsAsDataFrame(staff.sparkSession, result)
    assert frame.columns == ["entity", "instance", "name", "value"] and frame.count() == 12


def test_names_match_in_any_case_and_keep_their_spelling(staff):
    result = run(staff, Distinctness("BADGE"), Distinctness("Badge"))
    assert [row[2] for row in result.rows] == ["BADGE", "Badge"]
    assert {row[4] for row in result.rows} == {8 / 9}


def test_backticks_in_names(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0)], "`a``b.c` int, `x y` double")
    assert value(df, Completeness("a`b.c")) == 0.5
    assert value(df, Uniqueness(["a`b.c", "x y"])) == 1.0
    assert value(df, Mean("x y", "`a``b.c` IS NULL")) == 3.0


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, None), (None, None), (1, None), (2, 3)], "a int, b int")


def test_nulls_in_tuples(pairs):
    both = ["a", "b"]
    assert value(pairs, CountDistinct(both)) == 2
    assert value(pairs, Distinctness(both)) == pytest.approx(2 / 3)
    assert value(pairs, Uniqueness(both)) == pytest.approx(1 / 3)
    assert value(pairs, UniqueValueRatio(both)) == 0.5
    assert value(pairs, MutualInformation(both)) == 0.0
    assert value(pairs, Entropy("a")) == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert value(pairs, MutualInformation(["a", "a"])) == pytest.approx(value(pairs, Entropy("a")))


def test_null_predicate_counts_as_not_met(pairs):
    assert value(pairs, Compliance("b > 0")) == 0.25
    assert value(pairs, Compliance("b > 0", "b > 0", "a = 2")) == 1.0


def test_histogram_keeps_null_as_a_bin(pairs):
    rows = named(run(pairs, Histogram("a")))
    assert rows == {
        "Histogram.bins": 3,
        "Histogram.abs.1": 2,
        "Histogram.ratio.1": 0.5,
        "Histogram.abs.2": 1,
        "Histogram.ratio.2": 0.25,
        "Histogram.abs.NullValue": 1,
        "Histogram.ratio.NullValue": 0.25,
    }
    top = named(run(pairs, Histogram("a", 1)))
    assert top == {"Histogram.bins": 3, "Histogram.abs.1": 2, "Histogram.ratio.1": 0.5}


def test_types_of_text(spark):
    texts = ["1", "-2", "+ 3", "+3", "12\n", "123456789012345678901234567890", "1.5", ".5", "2.", "1e5", "true", "false", "True", "", " 7", "7 ", None]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    counts = run(df, DataType("t")).parts(DataType("t"), "DataType.abs.")
    assert counts == {"Unknown": 1, "Integral": 4, "Fractional": 3, "Boolean": 2, "String": 7}


def test_patterns_are_taken_as_written(spark):
    df = spark.createDataFrame([("call 212-376-9125",), ("2123769125",), (None,)], "phone string")
    assert value(df, PatternMatch("phone", r"\d{3}-\d{3}-\d{4}")) == pytest.approx(1 / 3)


SCALARS = [
    Completeness("a"),
    Compliance("a > 0"),
    Minimum("a"),
    Maximum("a"),
    Mean("a"),
    Sum("a"),
    StandardDeviation("a"),
    MinLength("t"),
    MaxLength("t"),
    Correlation("a", "a"),
    PatternMatch("t", "x"),
    ApproxQuantile("a", 0.5),
    ApproxQuantiles("a", [0.5], 0.0),
    Distinctness("a"),
    Uniqueness("a"),
    UniqueValueRatio("a"),
    Entropy("a"),
    MutualInformation(["a", "t"]),
]


def test_empty_input(spark):
    df = spark.createDataFrame([], "a int, t string")
    result = run(df, Size(), CountDistinct("a"), Histogram("a"), *SCALARS)
    assert {row[3]: row[4] for row in result.rows} == {"Size": 0, "CountDistinct": 0, "Histogram.bins": 0}
    assert {failure.error for failure in result.failures} == {"EmptyState"}
    assert [failure.metric for failure in result.failures] == SCALARS


def test_empty_under_a_condition(pairs):
    result = run(pairs, Size("a > 5"), Mean("a", "a > 5"), Mean("a"))
    assert result.value(Size("a > 5")) == 0
    assert result.value(Mean("a")) == pytest.approx(4 / 3)
    assert result.failure(Mean("a", "a > 5")).error == "EmptyState"


def test_faults_do_not_stop_the_run(staff):
    bad = {
        Mean("Nope"): "MissingColumn",
        Mean("Called"): "WrongType",
        MaxLength("Pay"): "WrongType",
        Compliance("Pay >"): "InvalidPredicate",
        Compliance("sum(Pay) > 1"): "InvalidPredicate",
        Compliance("late", "'First year' > 10"): "BadValue",
        Size("1"): "InvalidPredicate",
        PatternMatch("Tax id", "(["): "IllegalParameter",
        MutualInformation(["Pay"]): "IllegalParameter",
        ApproxQuantile("Pay", 2.0): "IllegalParameter",
        Uniqueness([]): "IllegalParameter",
        Histogram("Pay", -1): "IllegalParameter",
    }
    good = [Size(), Maximum("Pay")]
    result = run(staff, *good, *bad)
    assert {failure.metric: failure.error for failure in result.failures} == bad
    assert result.value(good[0]) == 10 and result.value(good[1]) == 200000


def test_doubled_names(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS A, 3 AS b")
    result = run(df, Mean("a"), Mean("b"), Uniqueness(["A", "b"]))
    assert [failure.error for failure in result.failures] == ["AmbiguousColumn"] * 2
    assert result.value(Mean("b")) == 3


def test_values_that_are_no_numbers_survive_in_frames(spark):
    df = spark.sql("SELECT * FROM VALUES (double('NaN'), 1D), (2D, double('Infinity')) AS t(a, b)")
    frame = AnalyzerContext.successMetricsAsDataFrame(spark, run(df, Mean("a"), Minimum("a"), Maximum("b")))
    values = [row.value for row in frame.collect()]
    assert math.isnan(values[0]) and values[1:] == [2.0, math.inf]


def test_a_bad_value_costs_one_probe_per_condition(staff, monkeypatch):
    """Only metrics under the failing condition are lost, and the rest run together once more."""
    from plumbline.plans import evaluation

    sizes = []
    whole = evaluation.metric_frame

    def counted(df, placed):
        sizes.append(len(placed))
        return whole(df, placed)

    monkeypatch.setattr(evaluation, "metric_frame", counted)
    bad = "cast(`Called` AS int) > 1"
    lost = [Size(bad), Mean("Pay", bad), Compliance("p", bad, "Pay > 0")]
    kept = [Size(), Size("Pay > 0"), Compliance("cast(Pay AS int) > 5"), Entropy("Tax id"), Mean("Years of age")]
    result = run(staff, *lost, *kept)
    assert [failure.metric for failure in result.failures] == lost
    assert {row[0] for row in result.rows} == {3, 4, 5, 6, 7}
    assert sizes == [8, 5]


def test_fused_equals_separate(staff):
    where = "Pay > 90000"
    metrics = [
        Size(where),
        Completeness("Badge", where),
        Mean("Pay"),
        StandardDeviation("Pay", where),
        ApproxQuantiles("Pay", [0.25, 0.9], 0.0),
        ApproxQuantile("Pay", 0.5, 0.01, where),
        Uniqueness("Badge"),
        Entropy("Badge", where),
        Histogram("First month"),
        DataType("Tax id", where),
    ]
    together = run(staff, *metrics)
    for metric in metrics:
        position = together.metrics.index(metric)
        alone = {row[3]: row[4] for row in run(staff, metric).rows}
        assert {row[3]: row[4] for row in together.rows if row[0] == position} == alone


@pytest.mark.parametrize("seed", [1, 2])
def test_counted_metrics_against_brute_force(spark, seed):
    """Random tuples with NULLs, a third of them alike."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, rng.random()]), rng.choice([None, "a", "b", "c"])) for _ in range(120)]
    rows += [(7.0, "hot")] * 60
    df = spark.createDataFrame([(x if x is None else float(x), y) for x, y in rows], "x double, y string")
    kept = [tuple(row) for row in df.collect()]
    pairs = Counter(row for row in kept if row != (None, None))
    n, once = sum(pairs.values()), sum(1 for c in pairs.values() if c == 1)
    full = Counter(row for row in kept if None not in row)
    full_n, xs, ys = sum(full.values()), Counter(), Counter()
    for (x, y), c in full.items():
        xs[x] += c
        ys[y] += c
    words = Counter(y for _, y in kept if y is not None)
    words_n = sum(words.values())
    both = ["x", "y"]
    expected = {
        CountDistinct(both): len(pairs),
        Distinctness(both): len(pairs) / n,
        Uniqueness(both): once / n,
        UniqueValueRatio(both): once / len(pairs),
        Entropy("y"): -sum(c / words_n * math.log(c / words_n) for c in words.values()),
        MutualInformation(both): sum(
            c / full_n * math.log(c * full_n / (xs[x] * ys[y])) for (x, y), c in full.items()
        ),
    }
    result = run(df.repartition(6), *expected, Histogram("y", 2))
    for metric, right in expected.items():
        assert result.value(metric) == pytest.approx(right), metric
    bins = Counter("NullValue" if y is None else y for _, y in kept)
    top = sorted(bins.items(), key=lambda item: (-item[1], item[0]))[:2]
    shown = {k.removeprefix("Histogram.abs."): v for k, v in named(result).items() if k.startswith("Histogram.abs.")}
    assert shown == dict(top)
    assert result.value(Histogram("y", 2)) == len(bins)


def test_order_of_rows_changes_nothing(spark):
    metrics = [Uniqueness(["Badge", "Tax id"]), Entropy("Called"), Histogram("First year"), Size()]
    rows = list(employees.ROWS) * 3
    random.Random(5).shuffle(rows)
    first = run(employees.frame(spark, list(employees.ROWS) * 3), *metrics).rows
    assert sorted(first) == sorted(run(employees.frame(spark, rows).repartition(5), *metrics).rows)


@pytest.mark.parametrize("accuracy", [10_000, 4, 20])
def test_exact_quantiles_by_selection(spark, monkeypatch, accuracy):
    """Coarse sketches force many rounds, and a hot value fills a third of the rows."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 2 / accuracy)
    rng = random.Random(accuracy)
    values = [float(rng.randint(-50, 50)) for _ in range(200)] + [7.25] * 100
    values += [rng.uniform(-1e6, 1e6) for _ in range(100)]
    rows = [(v, i % 3) for i, v in enumerate(values)] + [(None, 0)] * 20
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "v double, k int").repartition(4)
    asked = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, [("v", where, q) for where in (None, "k = 1") for q in asked])
    for where in (None, "k = 1"):
        kept = sorted(v for v, k in rows if v is not None and (where is None or k == 1))
        for q in asked:
            rank = max(1, math.ceil(round(q * len(kept), 9)))
            assert found["v", where, q] == kept[rank - 1], (where, q)


def test_contained_in_table(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "v int")
    allowed = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "ok string")
    assert value(df, ContainedInTable("v", allowed)) == 0.8
    assert value(df, ContainedInTable("v", allowed, "v >= 2")) == pytest.approx(2 / 3)
    assert value(df, ContainedInTable("v", allowed.filter("ok = '9'"))) == 0.2
    assert run(df, ContainedInTable("v", allowed.selectExpr("ok", "1 AS n"))).failures[0].error == "IllegalParameter"


def test_pandas_input(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0], "b": ["x", None, "z"]})
    result = AnalysisRunner(spark).onData(pdf).addAnalyzer(Mean("a")).addAnalyzer(Completeness("b")).run()
    assert [row[4] for row in result.rows] == [pytest.approx(7 / 3), pytest.approx(2 / 3)]


def test_decimal_and_time_columns(spark):
    df = spark.sql(
        "SELECT cast(id AS decimal(10,2)) AS d, timestamp_seconds(id) AS t, id % 2 = 0 AS b, "
        "cast(cast(id AS string) AS binary) AS x FROM range(10)"
    )
    assert value(df, Sum("d")) == 45.0 and value(df, Maximum("d")) == 9.0
    assert value(df, Uniqueness("t")) == 1.0 and value(df, Entropy("b")) == pytest.approx(math.log(2))
    assert value(df, Histogram("x")) == 10
    assert run(df, DataType("b")).parts(DataType("b"), "DataType.abs.")["Boolean"] == 10


def test_all_bins_and_texts_like_the_bin_of_null(spark):
    texts = [f"v{i}" for i in range(1500)] + ["NullValue", "\\NullValue", None]
    result = run(spark.createDataFrame([(t,) for t in texts], "s string"), Histogram("s"))
    found = named(result)
    assert len(found) == 1 + 2 * 1503 and found["Histogram.bins"] == 1503
    assert {"Histogram.abs.NullValue", "Histogram.abs.\\NullValue", "Histogram.abs.\\\\NullValue"} <= set(found)


def test_coarser_counts_come_from_finer_ones(spark):
    df = spark.createDataFrame([(i % 4, i % 6, None if i % 5 else i) for i in range(60)], "a int, b int, c int")
    sets = [["a"], ["b"], ["a", "b"], ["a", "b", "c"], ["c"]]
    metrics = [kind(columns) for columns in sets for kind in (CountDistinct, Uniqueness, Distinctness)]
    together = run(df, *metrics)
    assert [together.value(m) for m in metrics] == [value(df, m) for m in metrics]


def test_a_source_that_changes_is_a_failed_metric(spark):
    shifting = spark.range(5000).select((F.rand() * 1e6).alias("v"))
    result = run(shifting, ApproxQuantiles("v", [0.2, 0.7], 0.0), Size())
    assert result.value(Size()) == 5000
    assert all(failure.error == "ChangingSource" for failure in result.failures)


def test_lazy_frames_do_not_lose_failures(spark):
    df = spark.createDataFrame([("1", 2.0), ("x", None)], "t string, v double")
    asked = [Size(), Mean("gone"), Compliance("odd", "cast(t AS int) > 0"), Minimum("v", "v > 9"), Mean("v")]
    runner = AnalysisRunner(spark).onData(df).addAnalyzers(asked)
    with pytest.raises(ValueError, match="gone"):
        runner.asDataFrame()
    rows = {(r.name, r.instance): (r.value, r.error) for r in runner.asDataFrame(failures=True).collect()}
    assert rows == {
        ("Size", "*"): (2.0, None),
        ("Mean", "v"): (2.0, None),
        ("Mean", "gone"): (None, "MissingColumn"),
        ("Compliance", "odd"): (None, "BadValue"),
        ("Minimum", "v"): (None, "EmptyState"),
    }

"""What the plans look like: scans, pushed filters, reused shuffles."""

from conftest import FOLDER

from plumbline import (
    AnalysisRunner,
    ApproxCountDistinct,
    Completeness,
    ContainedInTable,
    CountDistinct,
    DataType,
    Histogram,
    Maximum,
    Mean,
    MutualInformation,
    Size,
    Uniqueness,
)
from plumbline.sources.frames import value_set


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def lazy(df, *metrics):
    return AnalysisRunner(df.sparkSession).onData(df).addAnalyzers(metrics).asDataFrame()


def test_scan_metrics_share_one_scan_of_their_columns(spark):
    metrics = [Size(), Completeness("o_custkey"), Mean("o_totalprice"), Maximum("o_totalprice", "o_orderkey > 5")]
    plan = final_plan(lazy(table(spark, "orders"), *metrics))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    assert "*(1) HashAggregate" in plan


def test_failures_come_from_the_scan_of_the_values(spark):
    metrics = [Size(), Mean("o_totalprice"), Maximum("o_totalprice", "o_orderkey < 0"), DataType("o_orderstatus", "o_orderkey < 0")]
    found = AnalysisRunner(spark).onData(table(spark, "orders")).addAnalyzers(metrics).asDataFrame(failures=True)
    assert final_plan(found).count("FileScan") == 1
    failed = sorted((row.name, row.error) for row in found.collect() if row.value is None)
    assert failed == [("DataType", "EmptyState"), ("Maximum", "EmptyState")]
    assert len([row for row in found.collect() if row.name.startswith("DataType.abs.")]) == 5


def test_a_common_condition_reaches_the_source(spark):
    where = "o_totalprice > 100000"
    plan = final_plan(lazy(table(spark, "orders"), Size(where), Mean("o_totalprice", where)))
    assert "GreaterThan(o_totalprice,100000.0)" in plan


def test_conditions_that_leave_rows_out_are_pushed_together(spark):
    metrics = [Size("o_totalprice > 100000"), Size("o_orderkey < 10")]
    plan = final_plan(lazy(table(spark, "orders"), *metrics))
    assert "Or(" in plan.split("PushedFilters")[1]


def test_sketches_leave_the_other_aggregates_in_generated_code(spark):
    plan = final_plan(lazy(table(spark, "orders"), Mean("o_totalprice"), ApproxCountDistinct("o_custkey")))
    assert plan.count("FileScan") == 2


def test_one_grouping_serves_all_metrics_on_the_same_columns(spark):
    pair = ["l_returnflag", "l_shipdate"]
    metrics = [CountDistinct(pair), Uniqueness(pair[::-1]), MutualInformation(pair)]
    plan = final_plan(lazy(table(spark, "lineitem"), *metrics))
    assert plan.count("FileScan") == 1
    df = lazy(table(spark, "lineitem"), Histogram("l_partkey", 5), Uniqueness("l_partkey"))
    assert final_plan(df).count("FileScan") == 1
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_part_of_the_columns_need_no_scan_of_their_own(spark):
    sets = ["l_returnflag", "l_linestatus", ["l_returnflag", "l_linestatus"]]
    metrics = [Uniqueness(columns) for columns in sets]
    plan = final_plan(lazy(table(spark, "lineitem"), *metrics))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_values_meet_the_reference_after_counting(spark):
    allowed = value_set(table(spark, "supplier"), "s_suppkey")
    plan = final_plan(lazy(table(spark, "lineitem"), ContainedInTable("l_suppkey", allowed)))
    join = plan[plan.index("Join") :]
    assert "functions=[count(1)]" in join and "CartesianProduct" not in plan and "NestedLoop" not in plan

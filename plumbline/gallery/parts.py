"""Metrics of a whole table from stored states of its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.gallery.base import EVENTS, Query, expected, rounded, table
from plumbline.operators.metrics import (
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    CountDistinct,
    DataType,
    Entropy,
    Histogram,
    Maximum,
    MaxLength,
    Mean,
    Metric,
    Minimum,
    MutualInformation,
    PatternMatch,
    Size,
    StandardDeviation,
    Sum,
    Uniqueness,
)
from plumbline.session import scratch_folder
from plumbline.streaming.ranges import RangeStates
from plumbline.streaming.states import StateStore

DAY = "cast(cast(ts AS date) AS string)"
HIGH = "value > 50"


def _store(spark: SparkSession) -> StateStore:
    return StateStore(spark, scratch_folder(spark, "states"))


def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Scan metrics of all days, merged from daily states."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    metrics: list[Metric] = [
        Size(),
        Size(HIGH),
        Completeness("kind"),
        Compliance("high", HIGH, "kind = 'click'"),
        PatternMatch("props", "[0-9]{2}"),
        Minimum("value"),
        Maximum("value", "kind = 'click'"),
        MaxLength("kind"),
        Mean("value"),
        Mean("value", HIGH),
        Sum("value"),
        StandardDeviation("value"),
        Correlation("value", "user_id"),
        DataType("kind"),
    ]
    store.save(events, metrics, F.expr(DAY))
    return rounded(store.metrics(events, metrics), 4)


def _merge_sql() -> str:
    source = EVENTS.sql
    kinds = {"Unknown": "kind IS NULL", "String": "kind IS NOT NULL"}
    rows = [
        ("Dataset", "*", "Size", f"SELECT count(*) FROM {source}"),
        ("Dataset", "*", "Size", f"SELECT count(*) FROM {source} WHERE {HIGH}"),
        ("Column", "kind", "Completeness", f"SELECT count(kind) / count(*) FROM {source}"),
        (
            "Column",
            "high",
            "Compliance",
            f"SELECT count(*) FILTER (WHERE {HIGH}) / count(*) FROM {source} WHERE kind = 'click'",
        ),
        (
            "Column",
            "props",
            "PatternMatch",
            f"SELECT count(*) FILTER (WHERE regexp_matches(props, '[0-9]{{2}}')) / count(*) FROM {source}",
        ),
        ("Column", "value", "Minimum", f"SELECT min(value) FROM {source}"),
        ("Column", "value", "Maximum", f"SELECT max(value) FROM {source} WHERE kind = 'click'"),
        ("Column", "kind", "MaxLength", f"SELECT max(length(kind)) FROM {source}"),
        ("Column", "value", "Mean", f"SELECT avg(value) FROM {source}"),
        ("Column", "value", "Mean", f"SELECT avg(value) FROM {source} WHERE {HIGH}"),
        ("Column", "value", "Sum", f"SELECT sum(value) FROM {source}"),
        ("Column", "value", "StandardDeviation", f"SELECT stddev_pop(value) FROM {source}"),
        ("Multicolumn", "value,user_id", "Correlation", f"SELECT corr(value, user_id) FROM {source}"),
    ]
    for kind in DataType.CLASSES:
        count = f"count(*) FILTER (WHERE {kinds.get(kind, 'FALSE')})"
        rows.append(("Column", "kind", f"DataType.abs.{kind}", f"SELECT {count} FROM {source}"))
        rows.append(("Column", "kind", f"DataType.ratio.{kind}", f"SELECT {count} / count(*) FROM {source}"))
    return expected(rows, 4)


COUNTED: list[Metric] = [
    CountDistinct("user_id"),
    Uniqueness("user_id", HIGH),
    Entropy("kind"),
    MutualInformation(["kind", "user_id"]),
    Histogram("kind"),
]


def incremental_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics on value counts of all days, merged from daily counts."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    store.save(events, COUNTED, F.expr(DAY))
    return rounded(store.metrics(events, COUNTED))


def _counts_sql() -> str:
    per_user = "SELECT count(*) AS c FROM events{} GROUP BY user_id"
    kinds = f"SELECT coalesce(kind, 'NullValue') AS v, count(*) AS c, sum(count(*)) OVER () AS n FROM {EVENTS.sql} GROUP BY 1"
    scalars = expected(
        [
            ("Column", "user_id", "CountDistinct", f"SELECT count(*) FROM ({per_user.format('')})"),
            (
                "Column",
                "user_id",
                "Uniqueness",
                f"SELECT count(*) FILTER (WHERE c = 1) / sum(c) FROM ({per_user.format(f' WHERE {HIGH}')})",
            ),
            (
                "Column",
                "kind",
                "Entropy",
                "SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n "
                f"FROM {EVENTS.sql} WHERE kind IS NOT NULL GROUP BY kind)",
            ),
            (
                "Multicolumn",
                "kind,user_id",
                "MutualInformation",
                f"WITH ab AS (SELECT kind AS a, user_id AS b, count(*) AS c FROM {EVENTS.sql} "
                "WHERE kind IS NOT NULL GROUP BY 1, 2), m AS (SELECT c, sum(c) OVER () AS n, "
                "sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb FROM ab) "
                "SELECT sum(c / n * ln(c * n / (ca * cb))) FROM m",
            ),
            ("Column", "kind", "Histogram.bins", f"SELECT count(*) FROM ({kinds})"),
        ]
    )
    return (
        f"{scalars} UNION ALL SELECT 'Column', 'kind', 'Histogram.abs.' || v, CAST(c AS DOUBLE) FROM ({kinds}) "
        f"UNION ALL SELECT 'Column', 'kind', 'Histogram.ratio.' || v, round(c / n, 6) FROM ({kinds})"
    )


def incremental_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Merged estimates of distinct users and of a quartile, held against exact values."""
    events, store = table(spark, folder, "events"), _store(spark)
    error = 0.02
    metrics = [ApproxCountDistinct("user_id"), ApproxQuantile("value", 0.25, error)]
    store.save(events, metrics, F.expr(DAY))
    estimates = store.metrics(events, metrics)
    users, quartile = (
        estimates.filter(F.col("name") == name).select("value").scalar()
        for name in ("ApproxCountDistinct", "ApproxQuantile-0.25")
    )
    users_exact = F.count_distinct("user_id")
    below = F.count_if(F.col("value") < quartile) / F.count("value")
    up_to = F.count_if(F.col("value") <= quartile) / F.count("value")
    return events.agg(
        users_exact.alias("users"),
        (F.abs(users - users_exact) <= 3 * 0.0163 * users_exact).alias("users_in_bound"),
        ((below <= 0.25 + error) & (up_to >= 0.25 - error)).alias("quartile_in_bound"),
    )


SKETCHES = "SELECT count(DISTINCT user_id) AS users, TRUE AS users_in_bound, TRUE AS quartile_in_bound FROM events"


def incremental_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Saving a part again replaces its states: first without clicks, then whole."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    metrics = [Size(), Mean("value"), Uniqueness("user_id")]
    store.save(events.filter("event_type <> 'click'"), metrics, F.expr(DAY))
    store.save(events, metrics, F.expr(DAY))
    return rounded(store.metrics(events, metrics), 4)


def incremental_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same metrics from a stream, each micro-batch being a part."""
    store = _store(spark)
    metrics = [Size(), Mean("value"), Uniqueness("user_id")]
    still = table(spark, folder, "events")
    stream = (
        spark.readStream.schema(still.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    query = (
        stream.writeStream.foreachBatch(store.batch_writer(metrics, "events"))
        .option("checkpointLocation", scratch_folder(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rounded(store.metrics(still, metrics), 4)


EVENTS_SQL = expected(
    [
        ("Dataset", "*", "Size", "SELECT count(*) FROM events"),
        ("Column", "value", "Mean", "SELECT avg(value) FROM events"),
        (
            "Column",
            "user_id",
            "Uniqueness",
            "SELECT count(*) FILTER (WHERE c = 1) / sum(c) "
            "FROM (SELECT count(*) AS c FROM events GROUP BY user_id)",
        ),
    ],
    4,
)

UNCLICKED_SQL = EVENTS_SQL.replace("FROM events", "FROM events WHERE event_type <> 'click'")
MERGED: list[Metric] = [Size(), Mean("value"), Uniqueness("user_id")]


def _first_days(events: DataFrame, number: int) -> list[str]:
    """The first days by name, and no others."""
    days = events.select(F.expr(DAY).alias("day")).distinct().orderBy("day").limit(number)
    return [row["day"] for row in days.collect()]


def incremental_late_part(spark: SparkSession, folder: str) -> DataFrame:
    """Data of days that have been rolled up already comes late: the days then count by themselves again."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    store.save(events.filter("event_type <> 'click'"), MERGED, F.expr(DAY))
    store.roll_up("early", _first_days(events, 3))
    store.save(events, MERGED, F.expr(DAY))
    return rounded(store.metrics(events, MERGED), 4)


def incremental_rollup_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A roll-up inside a larger one, and two that are refused: under a known name, and across the larger one."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    store.save(events, MERGED, F.expr(DAY))
    days = _first_days(events, 5)
    store.roll_up("two", days[:2])
    store.roll_up("three", days[:3])
    for name, parts in (("two", days[3:]), ("across", days[2:4])):
        try:
            store.roll_up(name, parts)
        except ValueError:
            continue
        raise AssertionError(f"the roll-up {name} was taken")
    return rounded(store.metrics(events, MERGED), 4)


def incremental_null_part(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a day are a part as well, which can be rolled up with others."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    store.save(events, MERGED, F.expr(f"CASE WHEN event_type <> 'click' THEN {DAY} END"))
    store.roll_up("some", [None, *_first_days(events.filter("event_type <> 'click'"), 2)])
    return rounded(store.metrics(events, MERGED), 4)


def states_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics at a version of the store, which later saves and roll-ups leave as they were."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    before = store.save(events.filter("event_type <> 'click'"), MERGED, F.expr(DAY))
    store.save(events, MERGED, F.expr(DAY))
    store.roll_up("early", _first_days(events, 2))
    return rounded(store.metrics(events, MERGED, at=before), 4)


EXACT = [
    ApproxQuantiles("value", [0.0, 0.1, 0.5, 0.95, 1.0], 0.0),
    ApproxQuantiles("user_id", [0.25, 0.75], 0.0, "event_type = 'click'"),
]


def incremental_quantiles_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles from the sorted values of each day; the first days are saved short at first, then whole."""
    events, store = EVENTS.frame(spark, folder), _store(spark)
    day = F.expr(DAY)
    early = events.where(F.col("ts") < events.agg(F.min("ts") + F.expr("INTERVAL 9 DAYS")).first()[0])
    store.save(early.where("value > 20"), EXACT, day)
    store.save(events, EXACT, day)
    return store.metrics(events, EXACT)


def _exact_sql() -> str:
    rows = [("value", q, "") for q in EXACT[0].quantiles]
    rows += [("user_id", q, " WHERE event_type = 'click'") for q in EXACT[1].quantiles]
    return expected(
        [
            ("Column", column, f"ApproxQuantiles-{q}", f"SELECT quantile_disc({column}, {q}) FROM events{where}")
            for column, q, where in rows
        ]
    )


#: Days from the first of 2024 on, ends included; some reach beyond the data, one is a single day.
RANGES = [(0, 29), (-5, 100), (3, 3), (1, 28), (7, 18), (12, 25), (16, 31)]
RANGED = [Size(), Mean("value"), Maximum("value"), CountDistinct("user_id"), ApproxQuantile("value", 0.5, 0.0)]
DAY_NUMBER = "datediff(ts, DATE '2024-01-01')"


def states_any_range(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of ranges of days, each from the few merged states that make it up; five days are saved again."""
    events = table(spark, folder, "events")
    store = RangeStates(spark, scratch_folder(spark, "ranges"), levels=5)
    number = F.expr(DAY_NUMBER)
    store.save(events.where((number < 10) | (number > 14) | (F.col("value") > 20)), RANGED, number)
    store.save(events.where(number.between(10, 14)), RANGED, number)
    found = [
        store.metrics(events, RANGED, first, last).withColumns({"first": F.lit(first), "last": F.lit(last)})
        for first, last in RANGES
    ]
    return rounded(reduce(DataFrame.unionByName, found), 4)


def _ranges_sql() -> str:
    values = [
        ("Dataset", "*", "Size", "count(*)"),
        ("Column", "value", "Mean", "avg(value)"),
        ("Column", "value", "Maximum", "max(value)"),
        ("Column", "user_id", "CountDistinct", "count(DISTINCT user_id)"),
        ("Column", "value", "ApproxQuantile-0.5", "quantile_disc(value, 0.5)"),
    ]
    days = "FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) BETWEEN {} AND {}"
    return " UNION ALL ".join(
        f"SELECT *, {first} AS first, {last} AS last FROM ("
        + expected([(*names, f"SELECT {value} {days.format(first, last)}") for *names, value in values], 4)
        + ")"
        for first, last in RANGES
    )


QUERIES = {
    "incremental_quantiles_exact": Query(incremental_quantiles_exact, _exact_sql()),
    "states_any_range": Query(states_any_range, _ranges_sql()),
    "incremental_late_part": Query(incremental_late_part, EVENTS_SQL),
    "incremental_rollup_twice": Query(incremental_rollup_twice, EVENTS_SQL),
    "incremental_null_part": Query(incremental_null_part, EVENTS_SQL),
    "states_snapshot": Query(states_snapshot, UNCLICKED_SQL),
    "incremental_merge": Query(incremental_merge, _merge_sql()),
    "incremental_counts": Query(incremental_counts, _counts_sql()),
    "incremental_sketches": Query(incremental_sketches, SKETCHES),
    "incremental_replace": Query(incremental_replace, EVENTS_SQL),
    "incremental_stream": Query(incremental_stream, EVENTS_SQL),
}

"""Exact quantiles of stored parts and metrics of ranges, against the data itself."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline import (
    AnalysisRunner,
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Correlation,
    CountDistinct,
    DataType,
    Entropy,
    Mean,
    Minimum,
    RangeStates,
    Size,
    StandardDeviation,
    StateStore,
    Sum,
)
from plumbline.session import scratch_folder
from plumbline.streaming.ranges import cover
from plumbline.streaming.runs import HEAD_SCHEMA, bounds_of, reaching
from plumbline.streaming.states import live_states, state_id

QUANTILES = [0.0, 0.01, 0.3, 0.5, 0.999, 1.0]
EXACT = ApproxQuantiles("x", QUANTILES, 0.0)


def at_ranks(values):
    """By sorting: NaN is the greatest value, NULL is none."""
    ordered = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    return {f"ApproxQuantiles-{q}": ordered[max(1, math.ceil(Fraction(str(q)) * len(ordered))) - 1] for q in QUANTILES}


def values_of(frame):
    return {row.name: row.value for row in frame.collect()}


def numbered(spark, rows):
    return spark.createDataFrame(rows, "n int, x double")


SHAPES = {
    "ties": lambda rng: float(rng.randrange(5)),
    "unique": lambda rng: rng.random(),
    "one value for most": lambda rng: 7.0 if rng.random() < 0.9 else rng.uniform(-100, 100),
    "wide": lambda rng: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
    "holes": lambda rng: rng.choice([None, math.inf, -math.inf, -0.0, 0.0, rng.random()]),
}


@pytest.mark.parametrize(("shape", "slot"), [*[(shape, 7) for shape in SHAPES], ("unique", 1), ("ties", 4096)])
def test_quantiles_of_parts(spark, shape, slot):
    rng = random.Random(3)
    rows = [(rng.randrange(4), SHAPES[shape](rng)) for _ in range(300)]
    df, store = numbered(spark, rows), StateStore(spark, scratch_folder(spark, "s"), slot)
    store.save(df, [EXACT], F.col("n"))
    assert values_of(store.metrics(df, [EXACT])) == at_ranks([x for _, x in rows])
    assert values_of(store.metrics(df, [EXACT], ["1", "3"])) == at_ranks([x for n, x in rows if n in (1, 3)])


def test_quantiles_with_not_a_number(spark):
    rows = [(i % 3, math.nan if i % 4 == 0 else float(i)) for i in range(200)]
    df, store = numbered(spark, rows), StateStore(spark, scratch_folder(spark, "s"), 5)
    store.save(df, [EXACT], F.col("n"))
    found, expected = values_of(store.metrics(df, [EXACT])), at_ranks([x for _, x in rows])
    assert {k: str(v) for k, v in found.items()} == {k: str(v) for k, v in expected.items()}


def test_quantiles_replaced_rolled_up_and_empty(spark):
    store = StateStore(spark, scratch_folder(spark, "s"), 8)
    rng = random.Random(5)
    held = {str(n): [float(rng.randrange(100)) for _ in range(40)] for n in range(4)}
    for part, values in held.items():
        store.save(numbered(spark, [(0, x) for x in values]), [EXACT, Size()], part)
    like = numbered(spark, [(0, 0.0)])

    def check():
        found = values_of(store.metrics(like, [EXACT, Size()]))
        every = [x for values in held.values() for x in values]
        assert found == {**at_ranks(every), "Size": len(every)}

    check()
    before = store.version()
    store.roll_up("old", ["0", "1"])
    check()
    held["1"] = [1000.0, None, -1000.0]
    store.save(numbered(spark, [(0, x) for x in held["1"]]), [EXACT, Size()], "1")
    found = values_of(store.metrics(like, [EXACT]))
    assert found == at_ranks([x for values in held.values() for x in values])
    held["2"] = []
    store.save(like.limit(0), [EXACT, Size()], "2")
    check_at = values_of(store.metrics(like, [EXACT], at=before))
    assert check_at["ApproxQuantiles-1.0"] < 1000
    assert values_of(store.metrics(like, [EXACT])) == at_ranks([x for values in held.values() for x in values])
    for part in held:
        store.save(like.limit(0), [EXACT], part)
    assert values_of(store.metrics(like, [EXACT])) == {}
    store.save(like, [Size()], "new")
    with pytest.raises(ValueError, match="state of every part"):
        store.metrics(like, [EXACT])


def test_conditions_and_spellings_share_what_they_can(spark):
    df, store = spark.range(1000).select(F.expr("id % 5 AS n"), F.expr("cast(id AS double) AS x")), StateStore(spark, scratch_folder(spark, "s"))
    some = ApproxQuantile("x", 0.5, 0.0, "n = 2")
    store.save(df, [EXACT, some], F.col("n"))
    assert store.metrics(df, [ApproxQuantile("X", 0.25, 0.0)]).first().value == 249.0
    assert store.metrics(df, [some]).first().value == 497.0
    with pytest.raises(ValueError, match="state of every part"):
        store.metrics(df, [ApproxQuantile("x", 0.5, 0.0, "n = 3")])


def test_few_slots_are_read(spark):
    """40 parts of 50 slots each: the bounds leave two or three slots of a part."""
    df = spark.range(200_000).select(F.expr("id % 40 AS n"), F.expr("cast(hash(id) AS double) AS x"))
    store, median = StateStore(spark, scratch_folder(spark, "s"), 100), ApproxQuantile("x", 0.5, 0.0)
    store.save(df, [median], F.col("n"))
    heads = store._read(store._heads_path, HEAD_SCHEMA, live_states(store._ledger.read()))
    run = state_id(df, median)
    ((rank, low, high),) = bounds_of(heads, [(run, 0.5)]).values()
    assert rank == 100_000
    assert heads.where("rows > 0").count() >= 40 * 50
    assert heads.where(reaching(run, low, high)).count() <= 40 * 4
    assert store.metrics(df, [median]).first().value == df.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").first()[0]


def test_covers():
    rng = random.Random(1)
    for _ in range(500):
        levels, first = rng.randrange(7), rng.randrange(-200, 200)
        last = first + rng.randrange(-1, 150)
        numbers = []
        for name in cover(first, last, levels):
            level, index = map(int, name.split("/"))
            assert level <= levels
            numbers += range(index << level, (index + 1) << level)
        assert numbers == list(range(first, last + 1))
        assert len(cover(first, last, levels)) <= 2 * (levels + 1) + (last - first + 1 >> levels)


ASKED = [
    Size(), Size("x > 0.5"), Mean("x"), StandardDeviation("x"), Sum("x"), Minimum("x"), Correlation("x", "y"), DataType("t"),
    CountDistinct(["t", "k"]), Entropy("t"), ApproxCountDistinct("t"), EXACT,
]


def events(spark, seed, numbers, rows=300):
    rng = random.Random(seed)
    made = []
    for _ in range(rows):
        x = None if rng.random() < 0.1 else rng.random()
        made.append((rng.choice(numbers), x, rng.random(), rng.choice(["a", "7", "1.5", None]), rng.randrange(3)))
    return spark.createDataFrame(made, "n int, x double, y double, t string, k int")


def same_as_data(store, df, first, last, asked=ASKED):
    found = sorted(store.metrics(df, asked, first, last).collect())
    whole = AnalysisRunner(df.sparkSession).onData(df.where(F.col("n").between(first, last))).addAnalyzers(asked)
    expected = sorted(whole.asDataFrame().collect())
    assert [row[:3] for row in found] == [row[:3] for row in expected]
    for a, b in zip(found, expected):
        assert a.value == pytest.approx(b.value, rel=1e-9, abs=1e-9), a


def test_any_range_after_replacements(spark):
    store = RangeStates(spark, scratch_folder(spark, "r"), levels=4)
    numbers = [-3, -1, 0, 1, 2, 5, 8, 9, 13, 15, 16, 31, 40]
    first, again = events(spark, 1, numbers), events(spark, 2, [-1, 5, 16, 33], 60)
    store.save(first, ASKED, F.col("n"))
    old = store.version()
    same_as_data(store, first, -3, 40)
    replaced = [row.n for row in again.select("n").distinct().collect()]
    store.save(again, ASKED, F.col("n"))
    now = first.where(~F.col("n").isin(replaced)).unionByName(again)
    for low, high in ((-100, 100), (-3, -3), (1, 9), (5, 32)):
        same_as_data(store, now, low, high)
    sizes = store.metrics(first, [Size()], -100, 100, at=old).first().value
    assert sizes == first.count()
    assert store.states(-3, 40).groupBy("id").count().agg(F.max("count")).first()[0] <= 10
    store.save(now.limit(0), ASKED, 8)
    same_as_data(store, now.where("n <> 8"), 1, 9)
    with pytest.raises(ValueError, match="state of every part"):
        store.metrics(now, [Size()], 50, 60)


def test_a_path_is_all_that_is_written(spark):
    store = RangeStates(spark, scratch_folder(spark, "r"), levels=6)
    df = spark.range(64).select(F.col("id").alias("n"))
    store.save(df, [Size()], F.col("n"))
    store.save(df.where("n = 17"), [Size()], 17)
    log = store._ledger.read().where("action = 'save'")
    assert log.where("version = 1").count() == 127 and log.where("version = 2").count() == 7
    for first, last in ((0, 63), (1, 62), (17, 40)):
        assert store.states(first, last).count() == len(cover(first, last, 6)) <= 10
        assert store.metrics(df, [Size()], first, last).first().value == last - first + 1


def test_metrics_that_some_numbers_lack(spark):
    store = RangeStates(spark, scratch_folder(spark, "r"), levels=3)
    df = spark.range(8).select(F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    store.save(df, [Size()], F.col("n"))
    store.save(df.where("n < 4"), [Sum("x")], F.col("n"))
    assert values_of(store.metrics(df, [Size(), Sum("x")], 0, 3)) == {"Size": 4, "Sum": 6}
    with pytest.raises(ValueError, match="Sum"):
        store.metrics(df, [Size(), Sum("x")], 0, 7)
    store.save(df.withColumn("n", F.when(F.col("n") > 3, F.col("n"))), [Sum("x")], F.col("n"))
    assert values_of(store.metrics(df, [Size(), Sum("x")], 0, 7)) == {"Size": 8, "Sum": 28}


def test_writers_of_neighbours(spark):
    """Each writes the nodes above both: whoever comes second merges them again."""
    store = RangeStates(spark, scratch_folder(spark, "r"), levels=3)
    df = spark.range(80).select(F.expr("id % 8 AS n"))

    def save(number):
        store.save(df.where(F.col("n") == number), [Size()], number)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(save, range(8)))
    for first, last in ((0, 7), (0, 3), (4, 7), (2, 5)):
        assert store.metrics(df, [Size()], first, last).first().value == 10 * (last - first + 1)

"""History, stamped tables, JDBC options, states."""

import random
import uuid
from concurrent.futures import ThreadPoolExecutor

import employees
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from plumbline import (
    AnalysisRunner,
    ApproxCountDistinct,
    ApproxQuantiles,
    Completeness,
    Compliance,
    ContainedInTable,
    Correlation,
    CountDistinct,
    DataType,
    Distinctness,
    Entropy,
    FileSystemMetricsRepository,
    Histogram,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MutualInformation,
    PatternMatch,
    ResultKey,
    Size,
    StandardDeviation,
    StateStore,
    Sum,
    Uniqueness,
    UniqueValueRatio,
)
from plumbline.session import scratch_folder
from plumbline.sources.frames import read_csv, value_set
from plumbline.sources.jdbc import JdbcTable
from plumbline.sources.stamped import JdbcMetricTable, MetricTable, stamp_and_append
from plumbline.streaming.log import CommitLog
from plumbline.streaming.states import scan_states

DAY = 24 * 60 * 60 * 1000


def metrics(spark, **values):
    rows = [("Column", "a", name, float(value)) for name, value in values.items()]
    return spark.createDataFrame(rows, "entity string, instance string, name string, value double")


def found(history, *tags):
    rows = history.getSuccessMetricsAsDataFrame(list(tags)).collect()
    return {(row.dataset_date, row.name): row.value for row in rows}


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_history_replaces_and_adds(spark, kind):
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"), kind)
    assert found(repository.load()) == {}
    first, second = ResultKey(spark, 5 * DAY + 7, {"tag": "x"}), ResultKey(spark, 9 * DAY, {"tag": "x"})
    repository.save(first, metrics(spark, Mean=1, Sum=2))
    repository.save(second, metrics(spark, Mean=3))
    repository.save(first, metrics(spark, Mean=10, Minimum=4))
    expected = {(5 * DAY + 7, "Mean"): 10, (5 * DAY + 7, "Sum"): 2, (5 * DAY + 7, "Minimum"): 4}
    assert found(repository.load()) == expected | {(9 * DAY, "Mean"): 3}
    assert found(repository.load().before(5 * DAY + 7)) == expected
    assert found(repository.load().before(5 * DAY + 6)) == {}
    repository.save(first, metrics(spark, Mean=10, Minimum=4))
    assert found(repository.load().before(6 * DAY)) == expected


def test_history_keeps_tags_and_filters_apart(spark):
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    for tags in ({"b": "1", "a": "2"}, {"a": "2", "b": "1"}, {"a": "3"}, {}):
        repository.save(ResultKey(spark, DAY, tags), metrics(spark, Mean=len(tags)))
    rows = repository.load().getSuccessMetricsAsDataFrame(["a", "b"]).orderBy("a", "b").collect()
    assert [(row.a, row.b, row.value) for row in rows] == [(None, None, 0), ("2", "1", 2), ("3", None, 1)]
    df = spark.range(10)
    runner = AnalysisRunner(spark).onData(df).addAnalyzer(Size()).addAnalyzer(Size("id < 3"))
    runner.useRepository(repository).saveOrAppendResult(ResultKey(spark, 2 * DAY, {})).run()
    sizes = repository.load().rows.filter("name = 'Size'").select("filter", "value").collect()
    assert {tuple(row) for row in sizes} == {(None, 10.0), ("id < 3", 3.0)}


def test_history_prunes_days(spark):
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    for day in range(4):
        repository.save(ResultKey(spark, day * DAY, {}), metrics(spark, Mean=day))
    plan = repository.load().before(DAY).latest()._jdf.queryExecution().executedPlan().toString()
    assert "dataset_day" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "LessThanOrEqual(dataset_date" in plan.split("PushedFilters:")[1]


def test_stamped_table(spark):
    target = MetricTable(spark, "stamped_metrics", scratch_folder(spark, "t"))
    stamp_and_append(metrics(spark, Mean=1.1), target, "analyzer")
    stamped = stamp_and_append(metrics(spark, Sum=2), target, "other", run="r")
    assert stamped.columns == ["entity", "instance", "name", "value", "tag", "timestamp", "run"]
    assert stamped.first().timestamp == stamped.first().timestamp
    target.append(stamped)
    rows = {(row.name, row.value, row.tag) for row in target.read().collect()}
    assert rows == {("Mean", 1.1, "analyzer"), ("Sum", 2.0, "other")}
    assert target.read().count() == 2


def test_jdbc_options_are_passed_on_and_not_shown(spark, monkeypatch):
    table = JdbcTable({"url": "jdbc:x", "dbtable": "metrics", "user": "u", "password": "secret"})
    assert "secret" not in repr(table)
    assert table.with_table("months").options["dbtable"] == "months" and table.options["dbtable"] == "metrics"
    ranged = table.partitioned("id", 0, 100, 8).options
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("id", 8)
    seen = {}

    def options(self, **given):
        seen.update(given)
        return self

    monkeypatch.setattr(DataFrameWriter, "options", options)
    monkeypatch.setattr(DataFrameWriter, "save", lambda self: seen.update(types=self._df.dtypes))
    stamp_and_append(metrics(spark, Mean=1), JdbcMetricTable(table), "analyzer")
    assert seen["password"] == "secret" and "value DOUBLE PRECISION" in seen["createTableColumnTypes"]
    assert dict(seen["types"])["timestamp"] == "string"


def test_csv_kinds(spark):
    path = scratch_folder(spark, "csv")
    employees.frame(spark).coalesce(1).write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    text = read_csv(spark, path)
    assert set(dict(text.dtypes).values()) == {"string"} and "Desk (ext). " in text.columns
    inferred = dict(read_csv(spark, path, infer=True).dtypes)
    assert inferred["First year"] == "int" and inferred["Pay"] == "string"
    semicolons = read_csv(spark, path, options={"sep": ";"})
    assert len(semicolons.columns) == 1
    assert value_set(text, "FIRST month").count() == 9


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        scratch_folder(Session(), "x")


PARTED = [
    Size(),
    Size("k = 1"),
    Completeness("x"),
    Compliance("x > 0", "x > 0", "k <> 2"),
    PatternMatch("t", "a"),
    Minimum("x"),
    Maximum("x", "k = 1"),
    MaxLength("t"),
    Mean("x"),
    Sum("x", "k = 2"),
    StandardDeviation("x"),
    Correlation("x", "y"),
    DataType("t"),
    CountDistinct(["t", "k"]),
    Distinctness("t"),
    Uniqueness(["x", "t"]),
    UniqueValueRatio("t", "k = 1"),
    Entropy("t"),
    MutualInformation(["t", "k"]),
    Histogram("t"),
]


def parted(spark, seed=1, n=400):
    """Values far from zero, so that moments by sums of squares would lose their digits."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = None if rng.random() < 0.1 else 1e9 + rng.random()
        t = rng.choice(["a", "ab", "7", "1.5", None, "true"])
        rows.append((f"p{i % 5}", x, rng.random() + (x or 0) / 1e9, t, i % 3))
    return spark.createDataFrame(rows, "part string, x double, y double, t string, k int")


def by_name(rows):
    return sorted((row[1], row[2], row[3]) for row in rows)


def test_merged_states_equal_a_full_run(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    store.save(df, PARTED, F.col("part"))
    merged = sorted(store.metrics(df, PARTED).collect())
    whole = sorted(AnalysisRunner(spark).onData(df).addAnalyzers(PARTED).asDataFrame().collect())
    assert [row[:3] for row in merged] == [row[:3] for row in whole]
    for a, b in zip(merged, whole):
        assert a.value == pytest.approx(b.value, rel=1e-6, abs=1e-9), a


def test_a_part_saved_again_replaces_itself(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    asked = [Size(), Mean("x"), Uniqueness("t"), Entropy("t")]
    store.save(df.filter("part = 'p0' AND k = 1"), asked, "p0")
    for part in ("p0", "p1", "p0"):
        store.save(df.filter(F.col("part") == part), asked, part)
    merged = sorted(store.metrics(df, asked).collect())
    both = df.filter("part IN ('p0', 'p1')")
    whole = sorted(AnalysisRunner(spark).onData(both).addAnalyzers(asked).asDataFrame().collect())
    assert [(r.name, pytest.approx(r.value)) for r in merged] == [(r.name, r.value) for r in whole]
    only = store.metrics(df, [Size()], parts=["p1"]).collect()
    assert only[0].value == df.filter("part = 'p1'").count()


def test_a_part_saved_empty_is_empty(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    asked = [*PARTED, ApproxCountDistinct("t"), ApproxQuantiles("x", [0.5], 0.01)]
    first, nothing = df.filter("part = 'p0'"), df.limit(0)

    def merged():
        return {(r.instance, r.name): r.value for r in store.metrics(df, asked).collect()}

    store.save(nothing, asked, "p0")
    zero = merged()
    assert zero["*", "Size"] == 0 and zero["t,k", "CountDistinct"] == 0 and ("x", "Mean") not in zero
    assert ("x", "ApproxQuantiles-0.5") not in zero and zero["t", "Histogram.bins"] == 0
    store.save(first, asked, "p0")
    assert merged()["x", "Mean"] > 1e9
    store.save(nothing, asked, "p0")
    assert merged() == zero


def test_micro_batches_merge(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    source, checkpoint = scratch_folder(spark, "in"), scratch_folder(spark, "cp")
    asked = [Size(), Mean("x"), Uniqueness(["t", "k"]), Histogram("t")]

    def drain():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = stream.writeStream.foreachBatch(store.batch_writer(asked, "s1"))
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def merged():
        return sorted(store.metrics(df, asked).collect())

    def whole(rows):
        return sorted(AnalysisRunner(spark).onData(rows).addAnalyzers(asked).asDataFrame().collect())

    early, late = df.filter("part < 'p3'"), df.filter("part >= 'p3'")
    for rows in (early, late):
        rows.repartition(2).write.mode("append").parquet(source)
        drain()
        expected = whole(early if rows is early else df)
        assert [(r[:3], pytest.approx(r.value)) for r in merged()] == [(r[:3], r.value) for r in expected]
    files = spark.read.schema(df.schema).parquet(source)
    store.save(files.limit(0), asked, "s1-9")
    assert [r[:3] for r in merged()] == [r[:3] for r in whole(df)]


def test_sketches_merge(spark):
    df = spark.range(20_000).selectExpr("id % 5000 AS u", "cast(id AS double) AS v", "id % 7 AS p")
    store = StateStore(spark, scratch_folder(spark, "s"))
    asked = [ApproxCountDistinct("u"), ApproxQuantiles("v", [0.1, 0.5], 0.01)]
    store.save(df, asked, F.col("p"))
    values = {row.name: row.value for row in store.metrics(df, asked).collect()}
    assert values["ApproxCountDistinct"] == pytest.approx(5000, rel=0.15)
    assert values["ApproxQuantiles-0.1"] == pytest.approx(2000, abs=200)
    assert values["ApproxQuantiles-0.5"] == pytest.approx(10_000, abs=200)


def test_metrics_without_states_are_refused(spark):
    store = StateStore(spark, scratch_folder(spark, "s"))
    with pytest.raises(ValueError, match="no mergeable state"):
        store.save(spark.range(3), [ContainedInTable("id", spark.range(2), label="two")], "p")
    with pytest.raises(ValueError, match="MissingColumn"):
        store.save(spark.range(3), [Mean("x")], "p")


def test_sketches_keep_the_error_asked_for(spark):
    df = spark.range(300_000).select(F.col("id").alias("u"), F.col("id").cast("double").alias("v"))
    store = StateStore(spark, scratch_folder(spark, "s"))
    exact = ApproxCountDistinct("u", relativeDeviation=0.005)
    store.save(df, [exact], "p")
    assert store.metrics(df, [exact]).first().value == pytest.approx(300_000, rel=0.015)
    for too_exact in (ApproxQuantiles("v", [0.5], 1e-6), ApproxCountDistinct("u", relativeDeviation=1e-5)):
        with pytest.raises(ValueError, match="no sketch"):
            store.save(df, [too_exact], "p")


def test_missing_states_are_an_error(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    with pytest.raises(ValueError, match="Size"):
        store.metrics(df, [Size()])
    for part in ("p0", "p1"):
        store.save(df.where(F.col("part") == part), [Size(), Mean("x")], part)
    store.save(df.where("part = 'p1'"), [Sum("x"), CountDistinct("t")], "p1")
    sizes = {r.name: r.value for r in store.metrics(df, [Size(), Mean("x")]).collect()}
    assert sizes["Size"] == df.where("part IN ('p0', 'p1')").count()
    for lacking in (Sum("x"), CountDistinct("t"), CountDistinct("k")):
        with pytest.raises(ValueError, match="state of every part"):
            store.metrics(df, [Size(), lacking])
    store.save(df.where("part = 'p0'"), [Sum("x"), CountDistinct("t")], "p0")
    assert store.metrics(df, [Size(), Sum("x"), CountDistinct("t")]).count() == 3


def test_roll_up_changes_no_value_and_counts_nothing_twice(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    store.save(df, PARTED, F.col("part"))
    before = sorted(store.metrics(df, PARTED).collect())
    store.roll_up("old", ["p0", "p1", "p2"])
    after = sorted(store.metrics(df, PARTED).collect())
    assert [(r[:3], pytest.approx(r.value)) for r in after] == [(r[:3], r.value) for r in before]
    assert store.metrics(df, [Size()], ["p1"]).first().value == df.where("part = 'p1'").count()
    store.save(df.where("part = 'p4'"), [Size()], "p5")
    with pytest.raises(ValueError, match="lack states"):
        store.roll_up("more", ["p4", "p5"])


def sizes(store, df, **how):
    return {(r.name, r.instance): r.value for r in store.metrics(df, [Size(), CountDistinct("x")], **how).collect()}


def days_of(spark, *days):
    return spark.createDataFrame([(day, float(i)) for i, day in enumerate(days)], "day string, x double")


def test_rolled_up_days_and_late_data(spark):
    """Against a plain list of saves, of which the last of a day counts."""
    store = StateStore(spark, scratch_folder(spark, "s"))
    asked, held = [Size(), CountDistinct("x")], {}

    def save(*days):
        rows = days_of(spark, *days)
        store.save(rows, asked, F.col("day"))
        for day in set(days):
            held[day] = [i for i, one in enumerate(days) if one == day]

    def same(**how):
        parts = how.get("parts") or held
        values = [i for day in parts for i in held[day]]
        found = sizes(store, days_of(spark, "x"), **how)
        assert found["Size", "*"] == len(values) and found["CountDistinct", "x"] == len(set(values))

    save("d1", "d1", "d2", "d3", "d4", "d4", None, None)
    same()
    same(parts=[None, "d1"])
    store.roll_up("early", ["d1", "d2"])
    same()
    with pytest.raises(ValueError, match="there already"):
        store.roll_up("early", ["d3", "d4"])
    same()
    store.roll_up("all", ["d1", "d2", "d3", None])
    same()
    with pytest.raises(ValueError, match="some of the parts and others"):
        store.roll_up("across", ["d3", "d4"])
    save("d3", "d3", "d3")
    same()
    same(parts=["d1", "d3"])
    save("d1", "d1", "d1", "d1", "d5")
    same()
    store.roll_up("again", ["d1", "d2", "d3", "d4", "d5", None])
    same()
    save(None)
    same()


def test_a_version_stays_as_it_was(spark):
    df, store = days_of(spark, "a", "a", "b"), StateStore(spark, scratch_folder(spark, "s"))
    asked, versions = [Size(), CountDistinct("x")], []
    versions.append((store.save(df, asked, F.col("day")), 3))
    lazy = store.metrics(df, [Size()])
    versions.append((store.save(days_of(spark, *"bbbbb"), asked, "b"), 7))
    versions.append((store.roll_up("ab", ["a", "b"]), 7))
    # A writer that dies between its files and its commit.
    store._write(scan_states(days_of(spark, *"aaaaaaaaa"), [Size()], "a"), store._scan_path, "half")
    versions.append((store.save(days_of(spark, "c"), asked, "c"), 8))
    assert [version for version, _ in versions] == [1, 2, 3, 4] and store.version() == 4
    for version, n in versions:
        assert sizes(store, df, at=version)["Size", "*"] == n
    assert lazy.first().value == 3
    with pytest.raises(ValueError, match="state of every part"):
        sizes(store, df, at=0)


def test_writers_beside_each_other(spark):
    """Each commit takes a version of its own, also where all try the same one."""
    log = CommitLog(spark, scratch_folder(spark, "log"), "who int")
    tried = []

    def slow(last):
        tried.append(last)
        if len(tried) == 1:
            log.commit(spark.createDataFrame([(0,)], "who int"))

    assert log.commit(spark.createDataFrame([(1,)], "who int"), slow) == 2 and tried == [0, 1]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: log.commit(spark.createDataFrame([(i,)], "who int")), range(2, 8)))
    assert sorted(got) == list(range(3, 9))
    assert sorted((r.version, r.who) for r in log.read().collect())[:2] == [(1, 0), (2, 1)]
    assert log.read().count() == 8 and log.read(2).count() == 2 and log.read(0).count() == 0

    def refuse(last):
        raise ValueError("no")

    with pytest.raises(ValueError):
        log.commit(spark.createDataFrame([(9,)], "who int"), refuse)
    assert log.version() == 8


def test_one_of_many_takes_a_version(spark, tmp_path):
    """All try the same name at once, again and again: one gets it, and its files alone are there."""
    log = CommitLog(spark, str(tmp_path / "log"), "who int")
    with ThreadPoolExecutor(8) as pool:
        for turn in range(40):
            asides = []
            for i in range(8):
                asides.append(tmp_path / "log" / f"_aside-{turn}-{i}")
                asides[i].mkdir(parents=True)
                (asides[i] / f"rows-{i}").write_text("")
            target = tmp_path / "log" / f"version={turn}"
            took = list(pool.map(lambda aside: log._take(str(aside), str(target)), asides))
            assert took.count(True) == 1
            assert [one.name for one in target.iterdir()] == [f"rows-{took.index(True)}"]


def test_two_frames_of_one_run_are_both_kept(spark):
    target = MetricTable(spark, f"stamped_{uuid.uuid4().hex}", scratch_folder(spark, "t"))
    df = days_of(spark, "a", "b")
    one = AnalysisRunner(spark).onData(df).addAnalyzers([Size()]).asDataFrame()
    two = AnalysisRunner(spark).onData(df).addAnalyzers([Mean("x")]).asDataFrame()
    for frame, tag in ((one, "analyzer"), (two, "analyzer"), (one, "check"), (one, "analyzer"), (two, "analyzer")):
        stamp_and_append(frame, target, tag, run="r1")
    assert sorted((r.tag, r.name) for r in target.read().collect()) == [("analyzer", "Mean"), ("analyzer", "Size"), ("check", "Size")]
    spark.sql(f"DROP TABLE {target.table}")


def test_streams_with_new_checkpoints_do_not_meet(spark):
    df, store = parted(spark), StateStore(spark, scratch_folder(spark, "s"))
    for stream in ("one", "two", "two"):
        store.batch_writer([Size()], stream)(df, 0)
    assert store.metrics(df, [Size()]).first().value == 2 * df.count()


def test_history_tells_metrics_apart_and_compacts(spark):
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    df = spark.range(10).withColumnRenamed("id", "lab")
    runner = AnalysisRunner(spark).onData(df).addAnalyzers([Compliance("lab", "lab > 3"), Compliance("lab", "lab > 5")])
    key = ResultKey(spark, 3 * DAY, {"value": "tagged"})
    for _ in range(3):
        runner.useRepository(repository).saveOrAppendResult(key).run()
    before = sorted(repository.load().getSuccessMetricsAsDataFrame(["value"]).collect())
    assert sorted(r.value for r in before) == [0.4, 0.6] and before[0].tag_value == "tagged"
    assert repository.load().rows.count() == 6
    repository.compact(3 * DAY)
    assert repository.load().rows.count() == 6
    repository.compact(4 * DAY)
    assert repository.load().rows.count() == 2
    assert sorted(repository.load().getSuccessMetricsAsDataFrame(["value"]).collect()) == before
    assert repository.load().getSuccessMetricsAsDataFrame().first().tags == {"value": "tagged"}


def test_history_interleaved(spark, monkeypatch):
    """Versions against a plain list of saves, with compactions, a save within one, and runs that die between."""
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    dice, values, versions = random.Random(7), {}, {0: {}}

    def save():
        day, value = dice.randrange(2), dice.random()
        names = dice.sample(["Mean", "Sum", "Size"], 2)
        version = repository.save(ResultKey(spark, day * DAY, {}), metrics(spark, **dict.fromkeys(names, value)))
        values.update({(day * DAY, name): value for name in names})
        versions[version] = dict(values)

    commit = CommitLog.commit

    def saved_within(log, rows, check=None):
        monkeypatch.setattr(CommitLog, "commit", commit)
        save()
        return commit(log, rows, check)

    def dies(log, rows, check=None):
        raise OSError("lost")

    for step in range(7):
        save()
        if step in (2, 5):
            monkeypatch.setattr(CommitLog, "commit", saved_within)
            version = repository.compact(3 * DAY)
            versions[version] = dict(values)
        if step in (3, 4):
            monkeypatch.setattr(CommitLog, "commit", dies)
            with pytest.raises(OSError):
                repository.save(ResultKey(spark, DAY, {}), metrics(spark, Mean=-1)) if step == 3 else repository.compact(3 * DAY)
            monkeypatch.setattr(CommitLog, "commit", commit)
    assert repository.version() == max(versions) == 11 and len(versions) == 12
    for version, expected in versions.items():
        assert found(repository.load(version)) == expected
    assert found(repository.load()) == values
    repository.expire(7)
    for version in range(7, 12):
        assert found(repository.load(version)) == versions[version]
    with pytest.raises(ValueError, match="expired"):
        repository.load(6)


def test_history_compacted_by_two(spark, monkeypatch):
    """The second of two compactions of the same files is refused; what both read stays as it was."""
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    assert repository.compact(9 * DAY) == 0
    for value in (1, 2):
        repository.save(ResultKey(spark, DAY, {}), metrics(spark, Mean=value))
    commit = CommitLog.commit

    def overtaken(log, rows, check=None):
        monkeypatch.setattr(CommitLog, "commit", commit)
        repository.compact(3 * DAY)
        return commit(log, rows, check)

    monkeypatch.setattr(CommitLog, "commit", overtaken)
    with pytest.raises(ValueError, match="meanwhile"):
        repository.compact(3 * DAY)
    assert found(repository.load()) == {(DAY, "Mean"): 2} and repository.load().rows.count() == 1
    assert repository.compact(3 * DAY) == repository.version() == 3


def test_history_saved_by_many(spark):
    """Saves from several threads all count, each under a version of its own; the last commit wins."""
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: repository.save(ResultKey(spark, DAY, {}), metrics(spark, Mean=i, **{f"m{i}": i})), range(6)))
    assert sorted(got) == list(range(1, 7))
    last = max(range(6), key=lambda i: got[i])
    assert found(repository.load()) == {(DAY, f"m{i}"): i for i in range(6)} | {(DAY, "Mean"): last}


def test_history_reads_files_that_count(spark):
    """After a compaction readers list its files only, and rows without a day are kept."""
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    undated = metrics(spark, Mean=9).selectExpr("*", "cast(NULL AS bigint) AS dataset_date", "map('tag', 'x') AS tags")
    for value in range(4):
        repository.save(ResultKey(spark, DAY, {}), metrics(spark, Mean=value))
    repository.compact(3 * DAY)
    files = repository.load().rows.inputFiles()
    assert len([name for name in files if "/rows/" in name]) == 1
    repository.save_keyed(undated)
    repository.compact(9 * DAY)
    assert found(repository.load()) == {(DAY, "Mean"): 3, (None, "Mean"): 9}


def test_saving_needs_repository_and_key(spark):
    repository = FileSystemMetricsRepository(spark, scratch_folder(spark, "h"))
    builder = AnalysisRunner(spark).onData(spark.range(3)).addAnalyzer(Size())
    with pytest.raises(ValueError, match="both"):
        builder.useRepository(repository).run()
    with pytest.raises(ValueError, match="both"):
        AnalysisRunner(spark).onData(spark.range(3)).saveOrAppendResult(ResultKey(spark, 1, {})).run()

"""How filters interact: what each removes in every order of applying them, from decision diagrams of failure masks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import column, importable

NAMES = "ABCDE"
#: What a document counts for: itself, a good one, a toxic one.
WEIGHTS = ("documents", "good", "toxic")
#: More filters have more orders than a report can hold (7! = 5,040 rows of steps for each part).
MOST_FILTERS = 7
STEP = {
    "part": pa.string(), "filter_order": pa.string(), "step": pa.int32(), "kept": pa.int64(), "removed": pa.int64(),
    "redundant": pa.int64(), "unique_fails": pa.int64(), "good_lost": pa.int64(), "toxic_lost": pa.int64(),
    "shapley": pa.int64(),
}
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


@dataclass(eq=False)
class Node:
    """What becomes of the documents that reach a filter: ``passing`` and ``failing`` lead on, ``weight`` counts them."""

    weight: tuple[int, ...]
    passing: Node | None = None
    failing: Node | None = None


@dataclass
class Diagram:
    """A decision diagram of failure masks, one level for each filter, in the order ``order``.

    Nodes of a level with the same ways on are one node.  The weight of a node counts the documents of any
    one path to it, so that equal halves share their nodes and still count each for itself.
    """

    order: list[int]
    known: list[dict[tuple[int, int], Node]] = field(default_factory=list)
    root: Node | None = None

    @classmethod
    def of(cls, masks: dict[int, tuple[int, ...]], size: int) -> Diagram:
        """Built from the weight of each mask; bit ``i`` says that filter ``i`` fails."""
        diagram = cls(list(range(size)), [{} for _ in range(size)])
        leaves: dict[tuple[int, ...], Node] = {}
        nothing = (0,) * len(next(iter(masks.values()), WEIGHTS))

        def build(level: int, mask: int) -> Node:
            if level == size:
                weight = masks.get(mask, nothing)
                return leaves.setdefault(weight, Node(weight))
            return diagram.node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        diagram.root = build(0, 0)
        return diagram

    def node(self, level: int, passing: Node, failing: Node) -> Node:
        key = (id(passing), id(failing))
        found = self.known[level].get(key)
        if found is None:
            weight = tuple(a + b for a, b in zip(passing.weight, failing.weight, strict=True))
            found = self.known[level][key] = Node(weight, passing, failing)
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; only nodes of these two levels change."""
        above, self.known[level], self.known[level + 1] = list(self.known[level].values()), {}, {}
        for one in above:
            a, b = one.passing, one.failing
            one.passing = self.node(level + 1, a.passing, b.passing)
            one.failing = self.node(level + 1, a.failing, b.failing)
            # What leads here from above stays right, as the node itself is kept.
            self.known[level][id(one.passing), id(one.failing)] = one
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Node]]:
        """The path of documents that pass all: each filter, and the node that it decides."""
        here = self.root
        for filter_ in self.order:
            yield filter_, here
            here = here.passing


def swaps(size: int) -> Iterator[int]:
    """Levels to exchange with the next, one after the other, to meet every order of ``size`` filters once."""
    if size < 2:
        return
    down = list(range(size - 2, -1, -1))
    sweeps = 0
    for inner in [*swaps(size - 1), None]:
        falling = sweeps % 2 == 0
        yield from down if falling else reversed(down)
        sweeps += 1
        if inner is not None:
            # The largest rests at the end it has come to, before the others or behind them.
            yield inner + 1 if falling else inner


def report_of(masks: dict[int, tuple[int, ...]], size: int) -> list[tuple]:
    """``(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for every order.

    A filter that comes first removes all its failures, and one that comes last only those that fail nothing else.
    """
    diagram = Diagram.of(masks, size)
    rows, fails, alone, total = [], [0] * size, [0] * size, [0] * size
    for level in [None, *swaps(size)]:
        if level is not None:
            diagram.swap(level)
        for step, (filter_, node) in enumerate(diagram.steps()):
            lost = node.failing.weight
            rows.append((tuple(diagram.order), step, filter_, node.passing.weight[0], *lost))
            total[filter_] += lost[0]
            if step == 0:
                fails[filter_] = lost[0]
            if step == size - 1:
                alone[filter_] = lost[0]
    return [
        (order, step + 1, kept, lost, fails[f] - lost, alone[f], good, toxic, total[f])
        for order, step, f, kept, lost, good, toxic in rows
    ]


def audit(masks: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step; ``masks (part, mask, documents, good, toxic)`` may repeat masks.

    Bit ``i`` of ``mask`` says that filter ``names[i]`` fails.  Masks of a part are counted before they meet, and a part
    is then one row of at most ``2 ** len(names)`` counts, whatever its documents.  Without rows there are none.
    """
    size = len(names)
    if not 1 <= size <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be told apart, not {size}")
    importable(masks.sparkSession)
    counted = masks.groupBy("part", "mask").agg(*(F.sum(x).alias(x) for x in WEIGHTS))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("masks"))

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                weights = {x["mask"]: tuple(x[w] for w in WEIGHTS) for x in found}
                rows = report_of(weights, size)
                told = [("".join(names[i] for i in order), *rest) for order, *rest in rows]
                columns = [[part] * len(rows), *zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=kind) for x, kind in zip(columns, STEP.values(), strict=True)], names=list(STEP)
                )

    return parts.mapInArrow(follow, STEPS)


def words_of(text: Column) -> Column:
    """Words between blanks, of which there are six kinds."""
    blanks = "\t\n\x0b\x0c\r"
    return F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), "")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, documents, good, toxic)``: documents counted by their source and by what they fail of A to E.

    A: under 200 words; B: less than half of the words differ; C: over 2 % capitals; D: one of ``#$%&*|``; E: the text
    of a smaller ``doc_id``.  NULL texts are empty ones, and NULL sources are the part ``''``.  A NULL ``doc_id`` is neither
    smaller nor larger than another, and has no labels; a ``doc_id`` labelled twice is good, or toxic, if either row says so.
    """
    text = F.coalesce(column("text").cast("string"), F.lit(""))
    words = words_of(F.col("text"))
    read = docs.select(
        column("doc_id").cast("long").alias("doc_id"),
        F.coalesce(column("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    size, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        size < 200,
        100 * F.size(F.array_distinct("words")) < 50 * size,
        100 * capitals > 2 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))
    facts = read.withColumn("words", words).select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("body"))
    marks = labels.groupBy(column("doc_id").cast("long").alias("doc_id")).agg(
        F.max((column("quality") == 1).cast("int")).alias("good"), F.max((column("toxic") == 1).cast("int")).alias("toxic")
    )
    told = facts.join(marks, "doc_id", "left").select(
        "doc_id", "part", "mask", F.unhex("body").alias("body"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "toxic"))
    )
    # Copies are counted by all that tells them apart before they meet: the ids of a text are never listed.
    kinds = ["body", "mask", "part", "good", "toxic"]
    copies = told.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n"))
    kinds_of = copies.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    first = kinds_of.groupBy("body").agg(F.min("least.doc_id").alias("first"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("unnamed")
    passing = kinds_of.join(first, "body").select("mask", "part", "good", "toxic", "n", own.alias("own"))
    each = F.array(
        F.struct(F.col("mask"), F.col("own").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
    )
    rows = passing.select("part", "good", "toxic", F.inline(each)).where("n > 0")
    counts = [F.col("n").alias("documents"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")]
    return rows.select("part", "mask", *counts)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failures(docs, labels))


ORACLE_SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), facts AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(first_id < facts.doc_id, false)] AS fails
  FROM facts LEFT JOIN marks ON facts.doc_id = marks.doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, fails
), orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)
), steps AS (
  SELECT filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) AS f,
    [instr('ABCDE', substr(filter_order, k, 1)) FOR k IN range(1, step)] AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(filter_order) = 5
), told AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS here, len([x FOR x IN before IF fails[x]]) > 0 AS earlier,
    len([x FOR x IN fails IF x]) = 1 AS once
  FROM steps, masks
), counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND once), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

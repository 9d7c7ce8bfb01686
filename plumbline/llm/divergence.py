"""How sources of a language differ in the terms they use, ranked by cells of equal counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.words import Numbers, arrow, column, importable, portions
from plumbline.session import scratch_folder

#: ASCII letters in lower case and the bytes of other characters make terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ONE, ADDED = 1_000_000_000, 5
LEAST_DOCUMENTS, RANKS = 30, 50
WORDS_KEPT = 300_000
#: Sources compared at once, parts that a language's terms are dealt into, and cells of a table held at once.
TILE, PARTS, CELLS = 256, 64, 4_000_000
COUNTED = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "documents": pa.int64()}
COUNTS = "lang string, source string, term string, n long, documents long"
APART = {"lang": pa.string(), "a": pa.int32(), "b": pa.int32(), "value": pa.int64()}


class Counter:
    """Occurrences of each term, and the documents that hold it, by group."""

    def __init__(self) -> None:
        self.words, self.groups = Numbers(), Numbers()
        self.n = np.zeros((0, 3), dtype=np.int64)

    def add(self, groups: list[tuple[str, str]], texts: list[str | None]) -> None:
        numbers, bounds = self.words.of([(x or "").encode().translate(TERMS).split() for x in texts])
        group = np.array([self.groups[x] for x in groups], dtype=np.int64)
        self.words.fresh.clear()
        self.groups.fresh.clear()
        # In a text first, then in its group: a text's terms are counted once each for the documents.
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        width = max(1, len(self.words))
        held, times = np.unique(row * width + numbers, return_counts=True)
        term, place = held % width, group[held // width]
        keys, at = np.unique(place * width + term, return_inverse=True)
        added = [keys // width << 40 | keys % width, np.bincount(at, times, len(keys)), np.bincount(at, minlength=len(keys))]
        self.n = np.concatenate([self.n, np.stack(added, axis=1).astype(np.int64)])
        if len(self.n) > 4 * WORDS_KEPT:
            self.merge()

    def merge(self) -> None:
        keys, at = np.unique(self.n[:, 0], return_inverse=True)
        sums = [np.bincount(at, self.n[:, i], len(keys)) for i in (1, 2)]
        self.n = np.stack([keys, *sums], axis=1).astype(np.int64)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, and a term ``''`` for each group, which then exists even without terms."""
        self.merge()
        words, groups = list(self.words), list(self.groups)
        for start in range(0, len(self.n), 50_000):
            key, n, documents = self.n[start : start + 50_000].T
            of = [groups[i] for i in key >> 40]
            terms = [words[i].decode() for i in key & (1 << 40) - 1]
            yield arrow({"lang": [x[0] for x in of], "source": [x[1] for x in of], "term": terms, "n": n, "documents": documents}, COUNTED)
        if groups:
            some = {"lang": [x[0] for x in groups], "source": [x[1] for x in groups], "term": [""] * len(groups)}
            yield arrow({**some, "n": [0] * len(groups), "documents": [0] * len(groups)}, COUNTED)
        self.__init__()


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for part, texts in portions(batches):
        counter.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), texts)
        if len(counter.words) > WORDS_KEPT:
            yield from counter.taken()
    yield from counter.taken()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, documents)`` summed over each task's texts; NULL is ``''`` in all three columns read.

    Every group has a row of the term ``''`` beside those of its terms, none of which is empty.
    """
    importable(docs.sparkSession)
    read = docs.select(*(F.coalesce(column(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    return read.mapInArrow(counted, COUNTS)


def share(n: Column, total: Column, terms: Column) -> Column:
    """One and the share of a term in ``ONE`` parts, rounded down, of exact numbers."""
    wide = "decimal(38,0)"
    above = ((n + ADDED).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")).cast(wide)
    below = total.cast("decimal(20,0)").cast(wide) + (terms * ADDED).cast(wide)
    return F.call_function("div", above, below) + 1


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The terms that are kept, ``(lang, term, source, n, lang_n, first)`` where they occur, and all groups ``(lang, source)``.

    Kept are the terms held by ``least`` documents of the language or more; ``first`` marks one row of each term.
    Both are stored, as they are read several times.
    """
    spark = docs.sparkSession
    folder, others = scratch_folder(spark, "terms"), scratch_folder(spark, "groups")
    # Dealt by language and term alone, so that the sums by term need no shuffle of their own.
    rows = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    rows = rows.withColumns(
        {"lang_n": F.sum("n").over(of_term), "held": F.sum("documents").over(of_term), "first": F.col("source") == F.min("source").over(of_term)}
    )
    rows.where((F.col("held") >= least) | (F.col("term") == "")).drop("documents", "held").write.parquet(folder)
    schema = "lang string, source string, term string, n long, lang_n long, first boolean"
    stored = spark.read.schema(schema).parquet(folder)
    terms = stored.where("term <> ''")
    sizes = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("total", "lang_total", "terms")})
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    none = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups.withColumns({"place": place, "none": none}).write.parquet(others)
    schema = "lang string, source string, total long, lang_total long, terms long, place int, none long"
    return terms, spark.read.schema(schema).parquet(others)


class Table:
    """Shares of terms in the sources of two tiles, and how far apart they put each pair of sources.

    Sources without a term have their share of no occurrence, at which ``add`` measures from.
    """

    def __init__(self, key: tuple, places: np.ndarray, none: np.ndarray, tile: int, cells: int) -> None:
        self.key, self.places, self.none, self.tile = key, places, none, tile
        self.some = max(1, cells // len(places))
        self.sums = np.zeros((len(places),) * 2, dtype=np.int64)

    def add(self, places: np.ndarray, p: np.ndarray, ends: np.ndarray) -> None:
        """The places and shares of some terms one after the other, and where each term ends."""
        columns = np.searchsorted(self.places, places)
        for low in range(0, len(ends), self.some):
            lengths = np.diff(ends[low : low + self.some], prepend=ends[low - 1] if low else 0)
            stretch = slice(ends[low] - lengths[0], ends[low] - lengths[0] + lengths.sum())
            table = np.tile(self.none, (len(lengths), 1))
            table[np.repeat(np.arange(len(lengths)), lengths), columns[stretch]] = p[stretch]
            for i in range(len(self.places) - 1):
                at_none = np.abs(self.none[i + 1 :] - self.none[i])
                self.sums[i, i + 1 :] += np.abs(table[:, i + 1 :] - table[:, i : i + 1]).sum(axis=0) - len(lengths) * at_none

    def told(self) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.places), 1)
        # A pair within one tile belongs to the table of that tile with itself.
        tile = self.places // self.tile
        low, high = divmod(self.key[2], 65536)
        own = (tile[i] == low) & (tile[j] == high)
        i, j = i[own], j[own]
        return arrow({"lang": [self.key[0]] * len(i), "a": self.places[i], "b": self.places[j], "value": self.sums[i, j]}, APART)


def apart(terms: DataFrame, groups: DataFrame, tile: int, cells_at_once: int) -> DataFrame:
    """``(lang, a, b, value)``: for places ``a < b`` of a language's sources, how much further apart than at no
    occurrence at all the terms held by either put them; one row for each pair and part of the terms.

    Terms are dealt by a hash into parts, and sources of a language by ``tile`` into columns of tables; a task
    holds the columns of two tiles and some terms at once.  Sources that lack a term have their share of no occurrence.
    """
    tiles = groups.groupBy("lang").agg((F.floor(F.max("place") / tile) + 1).cast("int").alias("tiles"))
    both = groups.where("terms > 0").join(tiles, "lang").withColumn("tile", F.floor(F.col("place") / tile).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    both = both.withColumn("other", other).withColumn("table", F.least("tile", "other") * 65536 + F.greatest("tile", "other"))
    dealt = both.select("lang", "source", "table", "place", "none", "total", "terms")
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    found = terms.select("lang", "source", "term", part.alias("part"), "n").join(dealt, ["lang", "source"])
    found = found.select("lang", "part", "table", "term", "place", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    bases = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    bases = bases.select("lang", "part", "table", F.lit("").alias("term"), "place", F.col("none").alias("p"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Table | None = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                cells = batch.column(4).slice(low, high - low)
                places, p = (cells.flatten().field(i).to_numpy() for i in (0, 1))
                ends = np.cumsum(cells.value_lengths().to_numpy())
                if held is None or held.key != keys[low]:
                    if held is not None:
                        yield held.told()
                    # Shares of no occurrence come first, as the term of theirs is empty.
                    held = Table(keys[low], places[: ends[0]], p[: ends[0]], tile, cells_at_once)
                    places, p, ends = places[ends[0] :], p[ends[0] :], ends[1:] - ends[0]
                held.add(places, p, ends)
        if held is not None:
            yield held.told()

    keys = ["lang", "part", "table"]
    rows = found.union(bases).repartition(*keys).groupBy(*keys, "term")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("cells")).sortWithinPartitions(*keys, "term")
    return rows.mapInArrow(measure, "lang string, a int, b int, value long")


def ranked(values: DataFrame, most: int | None = None) -> DataFrame:
    """``(lang, source, item, value, rank)``: by value from the largest, then by the bytes of the item."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = values.withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.where(F.col("rank") <= most)


def pair_ranks(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of a group's language, by the distance of the two sources' shares summed over all kept terms."""
    own = groups.select("lang", "source", "place", "none", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("none").alias("other_none"))
    pairs = own.join(other, "lang").where("place <> other")
    more = apart(terms, groups, TILE, CELLS).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    pairs = pairs.withColumns({"a": F.least("place", "other"), "b": F.greatest("place", "other")}).join(more, ["lang", "a", "b"], "left")
    value = F.col("terms") * F.abs(F.col("none") - F.col("other_none")) + F.coalesce("more", F.lit(0))
    return ranked(pairs.select("lang", "source", "item", value.alias("value")))


def term_ranks(terms: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """The terms whose share in a group is the furthest above that in its language, the first ``ranks`` of each group.

    Terms of a group with the same counts there and in the language are one cell, whose difference is worked out once.
    Cells of equal differences merge; the values that come before ``ranks`` terms of larger ones are kept, and only
    their cells are expanded into terms.
    """
    cell = ["lang", "source", "n", "lang_n"]
    cells = terms.groupBy(*cell).agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = cells.select(*cell, "times", value.alias("value")).where("value > 0")
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value stands for a term at least, so that no more than ``ranks`` values can matter.
    merged = merged.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= ranks)
    before = F.sum("times").over(falling) - F.col("times")
    chosen = merged.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value")
    chosen = cells.select(*cell, "value").join(chosen, ["lang", "source", "value"])
    found = terms.select(*cell, F.col("term").alias("item")).join(chosen, cell)
    return ranked(found.select("lang", "source", "item", "value"), ranks)


def report(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``, the rows of :func:`pair_ranks` and :func:`term_ranks`.

    A language of one source has no pairs, one without kept terms has pairs of value 0 and no terms, and a table
    without rows gives none.
    """
    terms, groups = kept_terms(docs, least)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_ranks(terms, groups).withColumn("part", F.lit("pair"))
    return pairs.select(columns).union(term_ranks(terms, groups, ranks).withColumn("part", F.lit("term")).select(columns))


ORACLE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS held FROM words GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term HAVING sum(held) >= 30
), langs AS (
  SELECT docs.lang, coalesce(any_value(total), 0) AS total, coalesce(any_value(terms), 0) AS terms
  FROM (SELECT DISTINCT lang FROM docs) docs LEFT JOIN (SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang) k
    ON docs.lang = k.lang GROUP BY docs.lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(counts.n) FILTER (kept.term IS NOT NULL), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source
    LEFT JOIN kept ON kept.lang = counts.lang AND kept.term = counts.term
  GROUP BY g.lang, g.source
), shares AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(counts.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(counts.n, 0) + 5)) // (groups.total + 5 * langs.terms) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (langs.total + 5 * langs.terms) AS q
  FROM groups JOIN kept ON groups.lang = kept.lang JOIN langs ON langs.lang = groups.lang
    LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source AND counts.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

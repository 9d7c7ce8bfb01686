"""Secret scans with an incremental ledger of blobs.

Every version of every path is known by the SHA-256 of its content.  Which pairs of a blob and a
rule's version have been scanned stands in a ledger; only the others are scanned, each blob once
however many paths and versions hold it, and the findings are joined back to all of them.  All
of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.words import column
from plumbline.session import scratch_folder


@dataclass(frozen=True)
class Rule:
    """A pattern that both Java and RE2 read alike; a match stands if its ``group`` has ``least`` characters.

    Matches are leftmost and do not overlap; those that fail are taken out afterwards.  A change of
    the pattern needs a new ``version``, which makes every blob unseen to the rule again.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in word)


KEYWORDS = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", 1, rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # A run of the class that is too short cannot hold a longer one, so the length may stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
LEDGER = {
    "scanned": "blob binary, rule string, rule_version int",
    "findings": "blob binary, rule string, rule_version int, span_start long, span_end long",
}


class BlobLedger:
    """What has been scanned so far, in a folder that all executors reach.

    Findings are written before the pairs they belong to are marked as scanned: a job that dies in
    between scans those blobs again, and the findings it then writes twice are read once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER[name])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def versions_of(df: DataFrame, path: str, content: str, version: str | None = None) -> DataFrame:
    text = F.coalesce(column(content).cast("string"), F.lit(""))
    return df.select(
        column(path).alias("path"),
        (column(version) if version else F.lit(0)).alias("version"),
        F.unhex(F.sha2(text, 256)).alias("blob"),
        text.alias("text"),
    )


def scan(
    versions: DataFrame,
    ledger: BlobLedger,
    path: str = "path",
    content: str = "content",
    version: str | None = None,
    rules: Sequence[Rule] = RULES,
) -> None:
    """Scan what the ledger has not seen, and enter it.

    A NULL content is an empty text; paths may be NULL or repeated; other columns are ignored.  A
    table without rows enters nothing.
    """
    rows = versions_of(versions, path, content, version)
    known = ledger.read("scanned")
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules))
    # A blob is read where it stands for the first time.
    holders = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("first"))
    pairs = (
        holders.withColumn("wanted", F.explode(wanted))
        .select("blob", "first", "wanted.*")
        .join(known, ["blob", "rule", "rule_version"], "left_anti")
    )
    due = pairs.groupBy("blob", "first").agg(F.collect_set("rule").alias("rules"))
    here = F.struct("path", "version")
    unseen = rows.alias("r").join(
        due.hint("shuffle_hash").alias("d"),
        (F.col("r.blob") == F.col("d.blob")) & here.eqNullSafe(F.col("d.first")),
    )
    unseen = unseen.select("d.blob", "d.rules", "r.text")
    ledger.append("findings", hits(unseen, rules))
    fresh = pairs.select("blob", "rule", "rule_version")
    ledger.append("scanned", fresh)


def hits(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans in code points of the matches of ``rules`` in ``text``, a row each.

    A text falls apart at the matches; the lengths of what lies between and of the matches give
    the places.  They are summed up row by row, as a text may hold any number of matches.
    """
    found = [
        F.when(
            F.array_contains("rules", rule.kind) & F.col("text").rlike(rule.pattern),
            F.struct(
                F.lit(rule.kind).alias("rule"),
                F.lit(rule.version).alias("rule_version"),
                F.arrays_zip(
                    F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
                    F.transform(
                        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), lambda hit: measured(hit, rule)
                    ).alias("hit"),
                ).alias("steps"),
            ),
        )
        for rule in rules
    ]
    each = (
        texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("found"))
        .select("blob", "found.rule", "found.rule_version", F.posexplode("found.steps").alias("place", "step"))
        .select("blob", "rule", "rule_version", "place", "step.gap", "step.hit.length", "step.hit.tested")
    )
    running = Window.partitionBy("blob", "rule", "rule_version").orderBy("place")
    end = F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(running)
    least = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.least)))
    return (
        each.withColumn("span_end", end.cast("long"))
        .where((F.col("length") > 0) & (F.col("tested") >= least[F.col("rule")]))
        .select(
            "blob",
            "rule",
            "rule_version",
            (F.col("span_end") - F.col("length")).cast("long").alias("span_start"),
            "span_end",
        )
        # A blob whose holder is there more than once has been scanned as often.
        .distinct()
    )


def measured(hit: Column, rule: Rule) -> Column:
    tested = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
    return F.struct(F.length(hit).alias("length"), F.length(tested).alias("tested"))


def findings(
    versions: DataFrame,
    ledger: BlobLedger,
    path: str = "path",
    content: str = "content",
    version: str | None = None,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """A row for each version of each path: its blob, and the spans found in it.

    ``spans`` is an array of ``(start, place, rule, end)`` in the order of start and of the rules as
    listed, empty if nothing was found.  Rows of ``versions`` keep their number.
    """
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    by_blob = (
        ledger.read("findings")
        .where(F.col("rule_version") == current[F.col("rule")])
        .distinct()
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("span_start").alias("start"),
                        order[F.col("rule")].alias("place"),
                        "rule",
                        F.col("span_end").alias("end"),
                    )
                )
            ).alias("spans")
        )
    )
    rows = versions_of(versions, path, content, version).drop("text")
    nothing = F.array().cast("array<struct<start:bigint,place:int,rule:string,end:bigint>>")
    return rows.join(by_blob, "blob", "left").select(
        "path", "version", "blob", F.coalesce("spans", nothing).alias("spans")
    )


def secret_report(spark: SparkSession, documents: DataFrame, folder: str | None = None) -> DataFrame:
    """The digest of the findings in ``documents``: a row per row, by ``doc_id``."""
    ledger = BlobLedger(spark, folder or scratch_folder(spark, "blobs"))
    scan(documents, ledger, "doc_id", "text")
    found = findings(documents, ledger, "doc_id", "text")
    told = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )
    count = {r.kind: number_of(r.kind) for r in RULES}
    return found.withColumn("told", told).select(
        F.col("path").alias("doc_id"),
        *(n.alias(f"n_{kind}") for kind, n in count.items()),
        F.sha2("told", 256).alias("base_sha256"),
        F.col("told").alias("spans"),
    )


def masked(spark: SparkSession, documents: DataFrame, folder: str | None = None) -> DataFrame:
    """``documents`` with the characters of every secret replaced by ``*``; all rows and columns stay.

    Only documents with findings meet them; which those are follows from the blob alone, so that a
    row needs no key.  ``n_chars``, if there, stays right, as each character gives one.
    """
    ledger = BlobLedger(spark, folder or scratch_folder(spark, "blobs"))
    scan(documents, ledger, "doc_id", "text")
    spans = (
        ledger.read("findings")
        .distinct()
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("spans"))
    )
    keyed = documents.select(
        F.struct(*(column(c) for c in documents.columns)).alias("row"),
        F.coalesce(column("text").cast("string"), F.lit("")).alias("body"),
    ).withColumn("blob", F.unhex(F.sha2("body", 256)))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        clear = F.greatest(span["span_start"], state["at"])
        end = F.greatest(span["span_end"], clear)
        kept = F.substring(F.col("body"), (state["at"] + 1).cast("int"), (clear - state["at"]).cast("int"))
        stars = F.repeat(F.lit("*"), (end - clear).cast("int"))
        return F.struct(F.concat(state["done"], kept, stars).alias("done"), end.alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(F.col("body"), (state["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.aggregate("spans", start, step, finish)
    text = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("row")["text"])
    joined = keyed.join(spans, "blob", "left").select("row", text.alias("clean"))
    return joined.select(
        *(
            (F.col("clean") if c == "text" else F.col("row").getField(c)).alias(c)
            for c in documents.columns
        )
    )


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["rule"] == kind)).cast("long")


def spans_sql(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    tested = f"regexp_extract(hits[i], '{pattern}', {rule.group})" if rule.group else "hits[i]"
    return f"""
    SELECT doc_id, row, '{rule.kind}' AS kind, {[r.kind for r in RULES].index(rule.kind)} AS place,
        before + gap AS start, before + gap + size AS stop
    FROM (
        SELECT *, coalesce(sum(gap + size) OVER (
            PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (
            SELECT doc_id, row, i, length(gaps[i]) AS gap, length(hits[i]) AS size, length({tested}) AS tested
            FROM (
                SELECT doc_id, row, string_split_regex(text, '{pattern}') AS gaps,
                    regexp_extract_all(text, '{pattern}') AS hits,
                    unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i
                FROM texts)))
    WHERE tested >= {rule.least}"""


ORACLE_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents
), hit AS ({" UNION ALL ".join(spans_sql(rule) for rule in RULES)}
), told AS (
    SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
        count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR),
            ',' ORDER BY start, place) AS spans
    FROM hit GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)
"""

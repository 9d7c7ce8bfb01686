"""Secret scans against Python's own regular expressions, and the ledger's bookkeeping."""

import hashlib
import re

import hard
import pytest
from conftest import FOLDER
from oracle import connect, duck_table, spark_table

import __spark_entry__ as entry
from plumbline.llm import secrets
from plumbline.session import scratch_folder

PATTERNS = [
    ("assign", r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def plain(text):
    text = text or ""
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


def test_report_against_plain(spark):
    docs = hard.documents(spark)
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        spans = plain(text)
        told = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        counts = [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        expected.append((doc_id, *counts, hashlib.sha256(told.encode()).hexdigest(), told))
    assert hard.rows_of(secrets.secret_report(spark, docs)) == sorted(expected, key=repr)
    assert any(row[1] for row in expected) and any(row[2] for row in expected)
    assert secrets.secret_report(spark, hard.none(spark)).count() == 0


def test_query(spark):
    name = "op6_secret_ledger"
    assert spark_table(entry.queries()[name](spark, FOLDER)) == duck_table(connect(FOLDER), entry.oracle_sql()[name])


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secrets.BlobLedger(spark, scratch_folder(spark, "ledger"))
    one = spark.createDataFrame([("a", 1, "token=abcdefghijkl"), ("b", 1, "token=abcdefghijkl"), ("c", 1, None)], "path string, v int, content string")
    secrets.scan(one, ledger, version="v")
    assert ledger.read("scanned").count() == 2 * 3 and ledger.read("findings").count() == 1
    two = one.union(spark.createDataFrame([("a", 2, "new text"), ("d", 1, None)], one.schema))
    secrets.scan(two, ledger, version="v")
    assert ledger.read("scanned").count() == 3 * 3
    secrets.scan(two, ledger, version="v")
    assert ledger.read("scanned").count() == 3 * 3
    found = {(r.path, r.version): len(r.spans) for r in secrets.findings(two, ledger, version="v").collect()}
    assert found == {("a", 1): 1, ("b", 1): 1, ("c", 1): 0, ("a", 2): 0, ("d", 1): 0}
    newer = [secrets.Rule("assign", 2, secrets.RULES[0].pattern, 2, 14), *secrets.RULES[1:]]
    secrets.scan(two, ledger, version="v", rules=newer)
    assert ledger.read("scanned").count() == 3 * 4
    assert all(not r.spans for r in secrets.findings(two, ledger, version="v", rules=newer).collect())


def test_masked(spark):
    docs = hard.documents(spark)
    clean = secrets.masked(spark, docs)
    assert clean.schema.simpleString() == docs.schema.simpleString()

    def stars(text):
        if text is None:
            return None
        out = list(text)
        for start, _, _, end in plain(text):
            out[start:end] = "*" * (end - start)
        return "".join(out)

    expected = [(*r[:1], stars(r[1]), *r[2:]) for r in (tuple(r) for r in docs.collect())]
    assert hard.rows_of(clean) == sorted(expected, key=repr)
    assert secrets.masked(spark, hard.none(spark)).count() == 0


@pytest.mark.parametrize("text", ["", "password=", "token==abcdefghijkl", "SECRET : 'abcdefghijklm'", "AKIA" + "A" * 14, "f" * 40])
def test_borders(spark, text):
    row = secrets.secret_report(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain(text))

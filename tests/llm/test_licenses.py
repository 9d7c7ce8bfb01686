"""License notices: the winnowing guarantee, alignments against edit distances, planted notices."""

import random

import hard
import numpy as np
from conftest import FOLDER

import __spark_entry__ as entry
from plumbline.llm import licenses as li
from plumbline.llm.contamination import normal_words


def test_winnowing_keeps_one_of_each_window():
    keys = np.random.default_rng(1).integers(0, 30, 200)
    kept = li.winnowed(keys, li.WINDOW)
    assert all(((kept >= i) & (kept < i + li.WINDOW)).any() for i in range(len(keys) - li.WINDOW + 1))
    assert li.winnowed(keys[:2], li.WINDOW).size == 1 and li.winnowed(keys[:0], li.WINDOW).size == 0


def test_alignment_costs_what_the_edit_distance_is():
    pick = random.Random(3)
    for _ in range(200):
        template = np.array([pick.randrange(1, 6) for _ in range(pick.randrange(1, 12))])
        region = np.array([pick.randrange(0, 6) for _ in range(pick.randrange(0, 14))], dtype=np.int64)
        slack = len(region) + len(template)
        pairs = li.align(template, region, slack)
        assert all(template[i] == region[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        row = [0] * (len(region) + 1)
        for i, a in enumerate(template, 1):
            last, row = row, [i]
            for j, b in enumerate(region, 1):
                row.append(min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1))
        cost, i, j = 0, 0, pairs[0][1] - pairs[0][0] if pairs else 0
        for a, b in [*pairs, (len(template), None)]:
            gap, over = a - i, (b - j if b is not None and i else 0)
            cost += max(gap, over)
            i, j = a + 1, (b or 0) + 1
        if pairs:
            assert cost <= min(row) + 0 or cost == len(template) - len(pairs)


def test_planted_notices(spark):
    mit = li.TEMPLATES["MIT"]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 11 != 5)
    rows = [(1, "x y " + mit + " z"), (2, changed), (3, " ".join(words[: len(words) // 2])), (4, li.TEMPLATES["MIT (line)"] * 3), (5, None)]
    found = {}
    for r in li.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault((r.doc_id, r.license), []).append(r)
    assert set(found) == {(1, "MIT"), (2, "MIT"), (4, "MIT (line)")}
    whole = found[1, "MIT"][0]
    assert whole.coverage == 1 and rows[0][1][whole.start : whole.end] == mit.rstrip(".") and len(whole.spans) == 1
    part = found[2, "MIT"][0]
    assert 0.85 < part.coverage < 0.95 and len(part.spans) > 3
    assert len(found[4, "MIT (line)"]) == 3
    for s in part.spans:
        assert " ".join(map(bytes.decode, normal_words(changed[s.start : s.end]))) in " ".join(map(bytes.decode, normal_words(mit)))


def test_hard_documents(spark):
    docs = hard.documents(spark)
    found = li.licenses(docs).collect()
    assert [(r.license, r.coverage) for r in found] == [("GPL-3.0 (line)", 1.0)]
    assert li.licenses(hard.none(spark)).count() == 0
    assert li.licenses(docs, {"none": "", "one": "one"}).where("license = 'one'").count() == 1


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = entry.queries()["op8_licenses"](spark, FOLDER).collect()
    got = {(r.doc_id, r.license) for r in found}
    lines = {n: b" " + b" ".join(normal_words(t)) + b" " for n, t in li.TEMPLATES.items()}
    for d in docs:
        words = b" " + b" ".join(normal_words(d.text)) + b" "
        assert {n for n, line in lines.items() if line in words} <= {n for i, n in got if i == d.doc_id}


def test_every_change_that_the_coverage_allows_is_found():
    scanner = li.Scanner(li.TEMPLATES)
    pick = random.Random(8)
    for name, template in li.TEMPLATES.items():
        words = [w.decode() for w in normal_words(template)]
        allowed = len(words) - int(np.ceil(li.COVERAGE * len(words)))
        line = name.endswith("(line)")
        changes = [[i] for i in range(len(words))] if line else []
        # Changes that leave the shortest stretches whole, and others.
        changes.append([(i + 1) * (len(words) + 1) // (allowed + 1) - 1 for i in range(allowed)])
        changes += [pick.sample(range(len(words)), allowed) for _ in range(20)]
        for places in changes:
            text = "before it " + " ".join("zzz" if i in places else w for i, w in enumerate(words)) + " after it"
            found = {(license, round(share * len(words))) for _, license, share, *_ in scanner.search([text])}
            assert (name, len(words) - len(places)) in found, (name, places)

"""The audit of filters against every order worked through document by document."""

from itertools import permutations
from math import factorial

import hard
import pytest
from conftest import FOLDER
from oracle import connect, duck_table, spark_table

import __spark_entry__ as entry
from plumbline.llm import filters
from plumbline.llm.filters import Diagram, report_of, swaps


def plain(rows, labels):
    """Rows ``(doc_id, source, text)``; labels ``(doc_id, quality, toxic)``."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = {}
    for i, source, text in rows:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        marks = [x for x in labels if i is not None and x[0] == i]
        parts.setdefault(source or "", []).append((fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    return [(part, *row) for part, docs in parts.items() for row in by_order(docs, "ABCDE")]


def by_order(docs, names):
    found = []
    for order in permutations(names):
        left = docs
        for step, f in enumerate(order):
            gone = [d for d in left if d[0][f]]
            left = [d for d in left if not d[0][f]]
            failing = [d for d in docs if d[0][f]]
            alone = [d for d in failing if sum(d[0].values()) == 1]
            found.append(("".join(order), step + 1, len(left), len(gone), len(failing) - len(gone), len(alone), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    total = {f: sum(r[3] for r in found if r[0][r[1] - 1] == f) for f in names}
    return [(*r, total[r[0][r[1] - 1]]) for r in found]


@pytest.mark.parametrize("size", range(1, 7))
def test_swaps_meet_every_order_once(size):
    order, met = list(range(size)), {tuple(range(size))}
    for level in swaps(size):
        order[level], order[level + 1] = order[level + 1], order[level]
        assert tuple(order) not in met
        met.add(tuple(order))
    assert len(met) == factorial(size)


def test_diagram_against_counting():
    import random

    pick = random.Random(5)
    for size in (1, 2, 3, 5):
        masks = {pick.randrange(1 << size): tuple(pick.randrange(4) for _ in range(3)) for _ in range(12)}
        diagram = Diagram.of(masks, size)
        for level in swaps(size):
            diagram.swap(level)
            for mask in range(1 << size):
                node = diagram.root
                for f in diagram.order:
                    node = node.failing if mask >> f & 1 else node.passing
                assert node.weight == masks.get(mask, (0, 0, 0))
            assert diagram.root.weight == tuple(map(sum, zip(*masks.values(), strict=True)))
        assert len(report_of(masks, size)) == size * factorial(size)


def test_equal_halves_share_nodes():
    diagram = Diagram.of({0: (1, 0, 0), 3: (1, 0, 0), 4: (1, 0, 0), 7: (1, 0, 0)}, 3)
    assert diagram.root.weight == (4, 0, 0) and len(diagram.known[2]) == 2
    diagram.swap(0)
    diagram.swap(1)
    assert len(diagram.known[1]) == 2 and diagram.order == [1, 2, 0]


def test_hard_documents(spark):
    docs = hard.documents(spark)
    copy = " ".join(f"w{i}" for i in range(250))
    more = [(100 + i % 3, copy, None, "s", None) for i in range(9)] + [(None, copy, None, "s", None), (2, copy, None, "t", None)]
    docs = docs.union(spark.createDataFrame([(*r, 1, 0.5, "b", "p", "w", "r", "s", "l", 3) for r in more], docs.schema))
    marks = [(2, 1, 0), (2, 0, 1), (6, None, 1), (None, 1, 1), (100, 1, 1), (7, 0, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert hard.rows_of(filters.report(docs, labels)) == sorted(plain(rows, marks), key=repr)
    assert filters.report(hard.none(spark), labels).count() == 0
    assert filters.report(docs, labels.limit(0)).where("good_lost > 0").count() == 0


def test_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 1, 1, 1, 0), ("q", 3, 4, 4, 4)], "part string, mask int, documents long, good long, toxic long")
    rows = hard.rows_of(filters.audit(masks, "XY").select("part", "filter_order", "step", "kept", "removed", "redundant", "shapley"))
    assert ("p", "XY", 1, 5, 3, 0, 6) in rows and ("p", "YX", 1, 8, 0, 0, 0) in rows and len(rows) == 8
    with pytest.raises(ValueError):
        filters.audit(masks, "ABCDEFGH")


def test_query(spark):
    name = "op12_filter_audit"
    found = spark_table(entry.queries()[name](spark, FOLDER))
    assert found == duck_table(connect(FOLDER), entry.oracle_sql()[name])
    assert len(found[1]) % 600 == 0 and found[1]

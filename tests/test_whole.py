"""Registered queries take in the whole of their tables: each against plain Python over all rows."""

from __future__ import annotations

from itertools import groupby
from pathlib import Path

import pytest

from spanloom.operators import matrix
from spanloom.plans import catalogue
from spanloom.sources.readers import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
NAMES = {3: "GREEN", 2: "BLUE", 1: "BLACK"}


def levels(doc_id, text):
    """The three rules at every character of the text."""
    rule = lambda p, k: 3 if (p + doc_id) % (5 + k) == 0 else 2 if (p + k) % 3 == 0 else 1
    return [max(rule(p, k) for k in range(3)) for p in range(len(text))]


def test_whole_texts_are_coloured(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    runs, dominant = set(), {}
    for doc_id, text in texts.items():
        best = levels(doc_id, text)
        for level, run in groupby(range(len(best)), best.__getitem__):
            run = list(run)
            runs.add((doc_id, NAMES[level], run[0], len(run)))
        g, b = best.count(3), best.count(2)
        dominant[doc_id] = "GREEN" if g and g >= b else "BLUE" if b else "BLACK"
    found = [tuple(r) for r in catalogue.QUERIES["union_coloring"](spark, SF).collect()]
    assert len(found) == len(runs) and set(found) == runs
    assert sum(r[3] for r in found) == sum(map(len, texts.values()))
    assert dict(map(tuple, catalogue.QUERIES["dominant_category"](spark, SF).collect())) == dominant


def test_stretches(spark):
    rows = spark.createDataFrame([(1, [3, 3, 1, 2, 2]), (2, []), (3, [1])], "k long, levels array<int>")
    found = matrix.stretches(rows, ["k"], "levels")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2, 3), (1, 2, 1, 1), (1, 3, 2, 2), (3, 0, 1, 1)]


def test_discovery_decides_every_document(spark):
    """Each document has one decision, and a passage that it holds word for word is among its references."""
    passages = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    holding = {(r.doc_id, i) for r in table(spark, SF, "documents").collect() for i, text in passages.items() if text in (r.text or "")}
    rows = catalogue.QUERIES["discover_units"](spark, SF).collect()
    assert sorted(r.d for r in rows) == sorted(2 * r.doc_id for r in table(spark, SF, "documents").collect())
    assert {r.status for r in rows} <= {"traced", "untraced"}
    assert holding and holding <= {(r.d // 2, x.u // 2) for r in rows for x in r.references or []}

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import verify as V


def never(a, b):
    raise AssertionError("the entailment model must not be asked")


@pytest.mark.parametrize(
    "a, b, sim, nli, expected",
    [
        ("自动停堆功能", "设备维护周期要求", 0.30, None, "BLACK"),
        ("系统应在自动停堆信号产生时执行停堆功能", "系统应在自动停堆信号产生时执行停堆功能", 0.97, None, "GREEN"),
        ("反应堆保护", "反应堆保护", 0.60, None, "GREEN"),
        ("提供自动停堆功能", "提供自动停堆", 0.86, None, "GREEN"),
        ("系统应提供反应堆保护系统的定期试验功能", "反应堆保护系统应提供定期试验功能", 0.80, (0.92, 0, 0), "BLUE"),
        ("系统应提供反应堆保护系统的定期试验功能", "反应堆保护系统应提供定期试验功能", 0.82, (0, 0.85, 0), "BLUE"),
        ("系统应采用四取二的停堆逻辑", "系统应采用三取二的停堆逻辑", 0.80, (0, 0, 0.9), "BLACK"),
        ("自动停堆模式下系统应自动断开断路器", "自动停堆模式下系统应自动断开断路器和停堆", 0.86, (0, 0, 0), "BLUE"),
        ("通信流量应满足实时性要求", "设备布置应便于维修", 0.60, (0, 0, 0), "BLACK"),
    ],
)
def test_decision_chain(a, b, sim, nli, expected):
    assert V.classify(a, b, sim, never if nli is None else lambda x, y: nli) == expected


def test_common_substrings():
    found = V.common_substrings("系统应提供自动停堆功能", "当自动停堆信号出现时系统应提供保护")
    assert found and all(n >= 4 for *_, n in found)
    assert V.common_substrings("甲乙丙丁戊己", "子丑寅卯辰巳") == []
    assert isinstance(V.common_substrings("反应堆保护" * 100, "反应堆保护" * 50 + "其他内容"), list)


def test_spans_apart():
    assert V.apart([(0, 10, 10), (5, 15, 10), (20, 25, 5)]) == [(0, 10, 10), (20, 25, 5)]
    assert V.apart([]) == []


@given(st.text("第一段落，短语；。\n 1)——a", max_size=60))
@settings(max_examples=100, deadline=None)
def test_phrases_slice_back(text):
    assert all(text[p.start : p.end] == p.text for p in V.decompose(text))


def test_decompose():
    phrases = V.decompose("第一段落，第一短语；第二短语。\n第二段落，另一个短语。")
    assert [p.text for p in phrases] == ["第一段落，", "第一短语；", "第二短语。", "第二段落，", "另一个短语。"]


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 4), (4, 2), (5, 5)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        sim = rng.random(shape)
        cost = np.where(sim >= 0.5, 1 - sim, 100.0)
        n, m = shape
        best = min(sum(cost[i, j] for i, j in (zip(range(n), p) if n <= m else zip(p, range(m)))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = V.assign(sim)
        free = min(n, m) - len(pairs)
        assert sum(cost[i, j] for i, j in pairs) + 100 * free == pytest.approx(best)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_pair_runs_give_both_texts_back():
    down, up = "1)系统应提供自动停堆功能；\n2)设备应便于维修。", "系统应提供自动停堆功能。其他内容与此无关。"
    r = V.verify_pair(down, up)
    assert "".join(t for t, _ in r["down_runs"]) == down and "".join(t for t, _ in r["up_runs"]) == up
    assert r["overall"] == "GREEN" and any(c == "GREEN" and "自动停堆" in t for t, c in r["down_runs"])
    assert V.verify_pair("", "x")["overall"] == "BLACK" and V.verify_pair(None, None)["down_runs"] == []


def test_verified_reports_failures(spark):
    def broken(texts):
        raise ValueError("no model")

    pairs = spark.createDataFrame([(1, "系统应提供停堆功能", "系统应提供停堆功能"), (2, None, "x")], "pair_id long, down string, up string")
    rows = {r.pair_id: r for r in V.verified(pairs, encoder=broken).collect()}
    assert rows[1].overall is None and "no model" in rows[1].error and rows[2].overall == "BLACK"

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import verify


def one(spark, expression, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [("<FZSDCS34-SyRS0011>", "syrs11"), ("<DCS-SyRS011>", "syrs11"), ("< A B-12 >", "ab-12"), ("plain", "plain"), ("<X-000>", "x-000"), ("<AB000>", "ab0")],
)
def test_id_core(spark, raw, expected):
    assert one(spark, T.id_core(F.col("a")), a=raw) == expected


def test_ids_and_references(spark):
    assert one(spark, T.normal_id(F.col("a")), a="< DCS-SyRS001>") == "<DCS-SyRS001>"
    assert one(spark, T.normal_reference(F.col("a")), a=" 3.2 、（系统） ") == "3.2(系统)"
    assert one(spark, T.leading_number(F.col("a")), a="3.2.1 系统") == "3.2.1"
    assert one(spark, T.section_numbers(F.col("a")), a="3.2.10.") == [3, 2, 10]


@pytest.mark.parametrize("raw, expected", [("QAl", "QA1"), ("1O2", "102"), ("1O", "1O"), ("1)自动停堆功能；", "自动停堆"), ("  • 反应堆\n保护Ⅻ", "反应堆保护XII"), ("", "")])
def test_normalised(spark, raw, expected):
    assert one(spark, T.normalised(F.col("a")), a=raw) == expected
    assert verify.normal(raw) == expected


def test_purified_keeps_short_phrases(spark):
    assert one(spark, T.purified(F.col("a")), a="1)自动停堆功能；") == "自动停堆功能"
    assert one(spark, T.purified(F.col("a")), a="2)专设安全设施驱动系统功能；") == "专设安全设施驱动系统"


def test_tokens_and_sentences(spark):
    assert one(spark, T.tokens(F.col("a")), a="采用F-SC1级DCS") == ["F-SC1", "DCS", "采用"]
    assert one(spark, T.sentences(F.col("a")), a="第一句话。短；第二句话！") == ["第一句话", "第二句话"]
    assert one(spark, T.list_items(F.col("a")), a="1) 自动停堆；\n-启动泵。\nab") == ["自动停堆", "启动泵"]
    assert one(spark, T.class_codes(F.col("a")), a="F-SC1 and fsc 2, F SC1") == ["F-SC1", "F-SC2"]


def test_small_expressions(spark):
    assert one(spark, T.sheet_name(F.col("a")), a="a/b:[c]*?") == "abc"
    assert one(spark, T.visible_lines(F.col("a"), 12), a="中文中文中文\nabc") == 3
    assert one(spark, T.html_escaped(F.col("a")), a="<a & b>\n") == "&lt;a &amp; b&gt;<br>"
    assert one(spark, T.clipped(F.col("a"), 3), a="abcdef") == "abc…(截断, 原文6字)"
    assert one(spark, T.outermost_json(F.col("a")), a='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, T.outermost_json(F.col("a")), a="none") is None
    assert one(spark, T.forward_title(F.col("a")), a="系统应满足要求，并且在任何时候保持可用") == "系统应满足要求"
    assert [one(spark, T.marker_kind(F.col("a")), a=x) for x in ("① x", "1) x", "一、x", "a) x", "• x", "- x", "x")] == ["circled", "number", "chinese", "letter", "bullet", "dash", None]


@settings(max_examples=25, deadline=None)
@given(a=st.text("ab中文 ,1)", max_size=12), b=st.text("ab中文 ,1)", max_size=12))
def test_likeness_is_symmetric_and_bounded(a, b):
    for f in (verify.bigram_likeness, verify.charset_likeness, verify.lcs_ratio):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1


def test_python_and_spark_likeness_agree(spark):
    pairs = [("系统应提供停堆", "系统提供停堆功能"), ("a", "a"), ("", "x"), ("甲乙", "丙丁")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.bigram_jaccard(F.col("a"), F.col("b")).alias("g"), T.char_set_jaccard(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        assert r.g == pytest.approx(verify.bigram_likeness(r.a, r.b)) and r.c == pytest.approx(verify.charset_likeness(r.a, r.b))

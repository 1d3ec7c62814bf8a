from __future__ import annotations

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from spanloom.operators import adjudicate, compare, layout, matrix, relations, units
from spanloom.plans import pipelines
from spanloom.sources import writers

DOWN = """1 概述
<SYS-DS001> 停堆功能
系统应在自动停堆信号产生时执行停堆功能，并记录动作时间。
<SYS-DS002>
系统应提供反应堆保护系统的定期试验功能，试验周期不超过一个月。
<SYS-DS003>
通信流量应满足实时性要求，网络负荷应低于百分之四十。
"""
UP = """3.1 自动停堆要求
<SYS-UP001>
系统应在自动停堆信号产生时执行停堆功能，并记录动作时间与结果。
<SYS-UP002>
反应堆保护系统应提供定期试验功能，试验周期不超过一个月。
<SYS-UP003>
设备布置应便于维修，维修通道的宽度应满足规范的要求。
"""


def docs(spark, name, text):
    return spark.createDataFrame([(name, text)], "doc string, text string")


def test_items(spark):
    found = {r.item_id: r for r in units.items(docs(spark, "d", DOWN)).collect()}
    assert list(found) and set(found) == {"<SYS-DS001>", "<SYS-DS002>", "<SYS-DS003>"}
    assert found["<SYS-DS001>"].content == "系统应在自动停堆信号产生时执行停堆功能，并记录动作时间。"
    assert units.document_type(docs(spark, "d", DOWN)).first().doc_type == "id_based"


def test_items_merge_and_drop_noise(spark):
    text = "<A-R1>\n第一行内容是完整的。\n<A-R1>\n第一行内容是完整的。\n第二行内容也是完整的。\n<A-R2>\n太短\n"
    rows = units.items(docs(spark, "d", text)).collect()
    assert [(r.item_id, r.content) for r in rows] == [("<A-R1>", "第一行内容是完整的。\n第二行内容也是完整的。")]


def test_sections_and_skeleton(spark):
    text = "目录\n1 概述 .... 3\n1 概述\n甲\n2.1 系统\n乙\n48 表格\n丙\n2.2 接口\n丁\n"
    rows = units.sections(docs(spark, "d", text)).orderBy("ord").collect()
    assert [(r.section_number, r.section_title, r.content) for r in rows] == [("1", "概述", "甲"), ("2.1", "系统", "乙"), ("48", "表格", "丙"), ("2.2", "接口", "丁")]
    numbered = spark.createDataFrame([("d", 0, [1]), ("d", 1, [2, 1]), ("d", 2, [48]), ("d", 3, [2, 2]), ("d", 4, [])], "doc string, ord int, number array<int>")
    assert [r.ord for r in units.monotonic_skeleton(numbered, ["doc"], "ord", "number").orderBy("ord").collect()] == [0, 1, 2]


def relation_table(spark):
    schema = "doc string, page_number int, ord int, headers array<string>, rows array<array<string>>"
    rows = [
        ("d", 8, 0, ["本文中的条目号", "上游文件章节", "文件说明"], [["<SYS-DS001>", "<SYS-UP001>", "u"], ["", "<SYS-UP002>\n<SYS-UP003>", "u"]]),
        ("d", 9, 0, ["本文中的条目号", "上游文件章节", "文件说明"], [["<SYS-DS002>", "<SYS-UP002>", "u"]]),
    ]
    return spark.createDataFrame(rows, schema)


def test_relation_tables(spark):
    whole = relations.continued_tables(relation_table(spark))
    assert whole.count() == 1
    rows = relations.parsed_relations(whole).orderBy("ord").collect()
    assert [(r.downstream_id, r.upstream_ref, r.upstream_doc) for r in rows] == [("<SYS-DS001>", "<SYS-UP001>", "u"), ("<SYS-DS001>", "<SYS-UP002>", "u"), ("<SYS-DS001>", "<SYS-UP003>", "u"), ("<SYS-DS002>", "<SYS-UP002>", "u")]


def test_resolution_tiers(spark):
    items = spark.createDataFrame([("u", "<UR-001>", "内容一", 0)], "doc string, item_id string, content string, ord int")
    sections = spark.createDataFrame([("u", "3.2", "系统功能", "系统应具备的功能描述", "3.2系统功能", 1), ("u", "3.2.1", "接口", "接口描述", "3.2.1接口", 2)], "doc string, section_number string, section_title string, content string, full_key string, ord int")
    keys = relations.content_keys(items, sections)
    refs = ["<UR-001>", "< UR-001>", "3.2", "3.2 系统功能", "系统功能要求", "3.2.1.5", "", "  ", None, "无关"]
    found = {r.ref: (r.tier, r.content) for r in relations.resolved(spark.createDataFrame([("u", r) for r in refs], "doc string, ref string"), keys).collect()}
    assert found["<UR-001>"] == (1, "内容一") and found["< UR-001>"] == (2, "内容一") and found["3.2"] == (3, "系统应具备的功能描述")
    assert found["3.2 系统功能"] == (4, "系统应具备的功能描述") and found["系统功能要求"] == (6, "系统应具备的功能描述") and found["3.2.1.5"] == (7, "接口描述")
    assert not {"", "  ", None, "无关"} & found.keys()
    near = relations.resolved_fuzzily(spark.createDataFrame([("u", "3.2系统的功能")], "doc string, ref string"), keys).first()
    assert near.key == "3.2系统功能" and near.ratio >= 0.7


@pytest.mark.parametrize("mode", pipelines.MODES)
def test_backward_modes(spark, mode):
    rels = relations.parsed_relations(relations.continued_tables(relation_table(spark)))
    rows = pipelines.backward(docs(spark, "d", DOWN), docs(spark, "u", UP), rels, mode).collect()
    pairs = {(r.downstream_id, r.upstream_ref) for r in rows}
    if mode == "table":
        assert len(rows) == 4 and all(r.upstream_content and r.downstream_content for r in rows)
    else:
        assert ("<SYS-DS001>", "<SYS-UP001>") in pairs
        assert any(r.downstream_id == "<SYS-DS003>" for r in rows)
    if mode == "hybrid":
        assert any("发现层" in r.evidence or "[suspicious]" in r.evidence for r in rows)


def test_verified_and_forward(spark):
    rels = relations.parsed_relations(relations.continued_tables(relation_table(spark)))
    rows = pipelines.backward(docs(spark, "d", DOWN), docs(spark, "u", UP), rels, "table")
    checked = pipelines.verified(rows).collect()
    assert any(r.overall == "GREEN" for r in checked) and all("".join(x.text for x in r.down_runs) == r.downstream_content for r in checked)
    entries = pipelines.forward(rows, docs(spark, "u", UP))
    assert entries.filter("has_trace").count() == 3
    total = matrix.forward_coverage(entries).filter("upstream_doc is null").first()
    assert (total.entries, total.traced, total.relations) == (3, 3, 4)


def test_adjudication(spark):
    rows = spark.createDataFrame([(1, "[suspicious] x", "r", True, 2), (2, "", "", False, 1), (3, "[added] y", "r", False, 1), (4, "", "r", True, 1), (5, "", "r", False, 3), (6, "", "", False, 0)], "seq int, evidence string, upstream_ref string, ambiguous boolean, n_candidates int")
    assert {r.seq: r.task_type for r in adjudicate.eligible(rows, ["seq"]).collect()} == {1: "suspicious", 2: "untraced", 3: "added", 4: "ambiguous"}
    calls = []

    def client(system, user, tokens):
        calls.append(tokens)
        return '{"verdict": "A", "confidence": 0.9}' if tokens > 2000 else "cut off {"

    tasks = spark.createDataFrame([(1, "k1", "q"), (2, "k2", "q")], "seq int, cache_key string, user string")
    cache = spark.createDataFrame([("k2", '{"verdict": "B"}')], "cache_key string, answer string")
    got = {r.seq: r for r in adjudicate.asked(tasks, client, cache).collect()}
    assert not got[1].cached and "0.9" in got[1].answer and got[2].cached
    table = [("ambiguous", "A", 0.5, True, "ignore"), ("suspicious", "A", 0.9, True, "opinion"), ("untraced", "无", 0.9, False, "none"), ("ambiguous", "A", 0.9, True, "confirm"), ("ambiguous", "A", 0.7, True, "advise"), ("untraced", "A", 0.9, False, "suggest_other")]
    df = spark.createDataFrame(table, "t string, v string, c double, g boolean, expected string")
    assert df.filter(adjudicate.disposition(F.col("t"), F.col("v"), F.col("c"), F.col("g")) != F.col("expected")).count() == 0
    labels = F.array(F.lit("候选A"), F.lit("候选B"))
    for raw, expected in (("候选B", "候选B"), ("选 候选A 吧", "候选A"), ("无合适", "无合适"), ("?", "无"), (None, "无")):
        assert spark.range(1).select(adjudicate.normal_verdict(F.lit(raw).cast("string"), labels).alias("x")).first().x == expected


def test_colours_and_comparison(spark):
    runs = spark.createDataFrame([(1, [("ab", "GREEN"), ("cd", "BLACK")]), (1, [("a", "BLACK"), ("bcd", "BLUE")])], "id int, runs array<struct<text:string,category:string>>")
    chars = matrix.character_categories(runs.withColumn("run_id", F.monotonically_increasing_id()), ["id", "run_id"])
    got = matrix.union_colouring(chars, ["id"]).orderBy("start").collect()
    assert [(r.category, r.start, r.length) for r in got] == [("GREEN", 0, 2), ("BLUE", 2, 2)]
    assert spark.range(1).select(matrix.category_of(F.lit("FF92D050")).alias("a"), matrix.category_of(F.lit("123456")).alias("b")).first() == ("GREEN", "BLACK")
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, value string")
    other = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, value string")
    assert {r.k: r.kind for r in compare.cell_diff(base, other, ["k"]).collect()} == {1: "missing", 2: "changed", 3: "same", 4: "extra"}


def test_layout(spark):
    line = "doc string, page long, block long, text string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, bold boolean, paint_order long"
    rows = [("d", 1, 1, "a", 10.0, 10.0, 90.0, 20.0, "f", 10.0, False, 1), ("d", 1, 2, "b", 10.0, 22.0, 90.0, 32.0, "f", 10.0, False, 2), ("d", 1, 3, "c", 10.0, 80.0, 90.0, 90.0, "f", 10.0, False, 3), ("d", 1, 4, "d", 100.0, 10.0, 190.0, 20.0, "f", 10.0, False, 0)]
    lines = spark.createDataFrame(rows, line)
    assert sorted(r.text for r in layout.paragraphs(lines.filter("block < 4")).collect()) == ["a\nb", "c"]
    order = {r.block: r.order for r in layout.reading_order(lines).collect()}
    assert order[1] < order[2] < order[3] and order[1] < order[4]
    region = spark.createDataFrame([("d", 1, 0.0, 0.0, 95.0, 34.0)], "doc string, page long, x0 double, y0 double, x1 double, y1 double")
    assert {r.block for r in layout.outside_regions(lines, region).collect()} == {3, 4}
    big = spark.createDataFrame([("d", 1, 0.0, 0.0, 240.0, 240.0), ("d", 1, 460.0, 460.0, 470.0, 470.0)], "doc string, page long, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r)[2:] for r in layout.grid_regions(big, 480.0, 480.0).collect()] == [(0.0, 0.0, 240.0, 240.0)]
    assert layout.joined_lines("系统应\n提供功能。\n<A-R1>\n内容\n1) 一\n2) 二") == "系统应提供功能。\n<A-R1>\n内容\n1) 一\n2) 二"
    assert layout.joined_lines("\n".join(f"• 第{i}项" for i in range(7))).count("\n") == 6


def test_repeated_lines(spark):
    rows = [("d", p, t) for p in range(10) for t in ("页眉 公司", f"正文{p}")] + [("d", 3, "句子。")]
    lines = spark.createDataFrame(rows, "doc string, page int, line string")
    kept = units.without_repeated_lines(lines, ["doc"], "page", "line")
    assert kept.filter("line = '页眉 公司'").count() == 0 and kept.count() == 11


def test_workbook_and_writers(spark, tmp_path):
    data = writers.workbook({"a": (writers.FORWARD_COLUMNS, [[1, "<x>", [{"text": "ok", "category": "GREEN"}], "", "", ""]])})
    with zipfile.ZipFile(BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "FF00B050" in sheet and "&lt;x&gt;" in sheet and "上游条目号" in sheet
    html = spark.range(1).select(writers.html_runs(F.array(F.struct(F.lit("a<b").alias("text"), F.lit("BLUE").alias("category")))).alias("h")).first().h
    assert html == '<span style="color:#0070C0">a&lt;b</span>'
    df = spark.range(3)
    assert writers.dump_stage(df, str(tmp_path), "s").count() == 3
    assert writers.output_name("m.xlsx").startswith("m_") and writers.output_name("m.xlsx").endswith(".xlsx")


def test_streaming_decisions(spark, tmp_path):
    from spanloom.operators import discovery
    from spanloom.streaming.discovery import decide_stream

    cols = "uid long, doc string, kind string, key string, content string"
    up = discovery.profiled(spark.createDataFrame([(101, "u", "item", "", "alpha beta gamma delta words"), (103, "u", "item", "", "unrelated other passage")], cols), latin=True)
    spark.createDataFrame([(2, "d", "item", "", "alpha beta gamma delta words again")], cols).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    decide_stream(stream, up, lambda rows, n: got.extend(rows.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(got) == 1 and got[0].d == 2 and got[0].references[0].u == 101

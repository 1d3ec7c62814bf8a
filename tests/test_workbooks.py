"""A workbook written and read back: merged cells, coloured runs, styles, files that are none."""

from __future__ import annotations

import io
import zipfile

from spanloom.sources import workbooks, writers

GREEN, BLUE = {"text": "停堆", "category": "GREEN"}, {"text": "功能", "category": "BLUE"}


def test_saved_rows(spark):
    data = writers.workbook(
        {
            "甲": (writers.BACKWARD_COLUMNS, [[1, "<D1>", [GREEN, BLUE], "需求", "<U1>", "上文", "甲"], [2, "", "", "需求", "<U2>", [BLUE], "甲"], [3, "<D2>", "", "需求", "<U3>", "", "甲"], [4, "<D3>", "内容", "", "", "", "甲"]]),
            "乙": (writers.BACKWARD_COLUMNS, [[1, "", "", "需求", "<U4>", "x", "乙"]]),
        }
    )
    cells, errors = workbooks.workbook_cells(spark.createDataFrame([("a.xlsx", bytearray(data)), ("b.xlsx", bytearray(b"no workbook"))], "path string, content binary"))
    assert [r.path for r in errors.collect()] == ["b.xlsx"]
    rows = {r.upstream_ref: r for r in workbooks.saved_rows(cells).collect()}
    assert set(rows) == {"<U1>", "<U2>", "<U3>", "<U4>"}
    assert [(rows[u].downstream_id, rows[u].downstream_content) for u in ("<U1>", "<U2>", "<U3>", "<U4>")] == [("<D1>", "停堆功能"), ("<D1>", "停堆功能"), ("<D2>", "停堆功能"), ("", "")]
    assert [tuple(r) for r in rows["<U2>"].down_runs] == [("停堆", "GREEN"), ("功能", "BLUE")] and rows["<U2>"].up_category == "BLUE" and rows["<U1>"].up_category == "BLACK"


def test_shared_strings_and_styles(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts><font/><font><color rgb="FF92D050"/></font><font><color theme="1"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/><xf fontId="2"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>plain</t></si><si><r><rPr><color rgb="FF002060"/></rPr><t>rich</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" s="1" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="AA2" s="2"><v>3.5</v></c><c r="D2"/></row></sheetData></worksheet>')
    cells, _ = workbooks.workbook_cells(spark.createDataFrame([("c.xlsx", bytearray(out.getvalue()))], "path string, content binary"))
    assert sorted((r.letter, r.text, r.category) for r in cells.collect()) == [("A", "plain", "GREEN"), ("AA", "3.5", "BLACK"), ("B", "rich", "BLUE")]


def test_backward_workbooks_read_back(spark):
    cols = "downstream_doc string, seq long, downstream_id string, downstream_content string, upstream_doc string, upstream_ref string, upstream_content string, relation_source string, candidate_score double, evidence string, ambiguous boolean, down_runs array<struct<text:string,category:string>>"
    green, blue = [("内容一", "BLACK"), ("尾", "GREEN")], [("内", "BLUE"), ("容一尾", "BLACK")]
    rows = [
        ("甲", 1, "<D1>", "内容一尾", "需求", "<U1>", "长" * 100, "table", 0.0, "", False, green),
        ("甲", 1, "<D1>", "内容一尾", "需求", "<U2>", "\x01短", "discover", 0.456, "e", True, blue),
        ("甲", 2, "<D2>", None, "需求", "<U3>", "", "hybrid", 0.0, None, False, None),
        ("乙", 1, "<D3>", "丙", "需求", "<U4>", "x", "table", 0.9, "", None, None),
    ]
    made = writers.backward_workbooks(spark.createDataFrame(rows, cols)).cache()
    assert {r.downstream_doc: r.sheet for r in made.collect()} == {"甲": "甲", "乙": "乙"}
    cells, errors = workbooks.workbook_cells(made.select(made.downstream_doc.alias("path"), "content"))
    assert errors.count() == 0
    got = {(r.path, r.letter, r.row_no): r for r in cells.collect()}
    assert got["甲", "K", 2].text == "待人工确认"
    assert [(r.text, r.category) for r in got["甲", "C", 2].runs] == [("内", "BLUE"), ("容一", "BLACK"), ("尾", "GREEN")]
    assert {c.text for k, c in got.items() if k[1] == "I" and k[2] > 1} == {"0.46"}
    saved = {(r.downstream_id, r.upstream_ref, r.downstream_content) for r in workbooks.saved_rows(cells).collect()}
    assert {("<D1>", "<U1>", "内容一尾"), ("<D1>", "<U2>", "内容一尾"), ("<D3>", "<U4>", "丙")} <= saved
    with zipfile.ZipFile(io.BytesIO(made.filter("downstream_doc = '甲'").first().content)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<mergeCell ref="C2:C3"/>' in sheet and '<col min="6" max="6" width="70" customWidth="1"/>' in sheet
    # 200 columns in 68 make 3 lines, so 3 * 17 + 4; one line of the rest
    assert 'ht="55"' in sheet and 'ht="21"' in sheet

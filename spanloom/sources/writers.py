"""Sinks: matrices as Parquet, JSON, Markdown, HTML and workbooks; caches; stage dumps."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from datetime import datetime
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.options import COLOURS

# The columns of the sheets.
BACKWARD_COLUMNS = ("序号", "下游条目号", "下游内容", "上游文档", "上游条目号/章节", "上游内容", "下游文档", "关系来源", "置信度", "证据", "待人工确认", "AI 审核意见")
CLASSES = ("BLACK", "BLUE", "GREEN")  # from the lowest to the highest
FORWARD_COLUMNS = ("序号", "上游条目号", "上游内容", "下游文档", "下游条目号", "下游内容")


def save_matrix(rows: DataFrame, path: str, sheet: str = "downstream_doc") -> None:
    """[K1, K2] A matrix, a folder for each sheet."""
    rows.write.mode("overwrite").partitionBy(sheet).parquet(path)


# Widths of a backward sheet's columns, in characters.
BACKWARD_WIDTHS = (6, 22, 55, 20, 22, 70, 20, 10, 8, 48, 10, 48)
#: Heights in points: the least of a row, of a line, and what a row has besides its lines.
LEAST_HEIGHT, LINE_HEIGHT, PADDING = 15.0, 17.0, 4.0
_RUNS = "array<struct<text:string,category:string>>"


def _height(*texts: tuple[str, int]) -> Column:
    lines = F.greatest(F.lit(1), *(T.generous_lines(F.col(name), width) for name, width in texts))
    return F.greatest(F.lit(LEAST_HEIGHT), lines * LINE_HEIGHT + PADDING)


def backward_rows(rows: DataFrame) -> DataFrame:
    """[K1] Rows of backward sheets: the twelve columns, numbered from 1 in each sheet, besides ``rows_of_unit``, ``place`` in the unit and ``height``.

    ``rows`` are of a backward matrix; ``ai_opinion``, ``down_runs`` and ``up_runs`` may be missing. A unit's
    rows share a ``seq``; their order is that of upstream documents, references and contents. The score is
    shown, with two decimals, of rows found by content only. Nulls are shown as empty.
    """
    absent = {"ai_opinion": "string", "down_runs": _RUNS, "up_runs": _RUNS}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in rows.columns})
    order = ("seq", F.desc("candidate_score"), "upstream_doc", "upstream_ref", "upstream_content", "evidence")
    unit = Window.partitionBy("downstream_doc", "seq")
    n = F.count("*").over(unit)
    placed = rows.withColumns({"rows_of_unit": n, "place": F.row_number().over(unit.orderBy(*order)), "number": F.row_number().over(Window.partitionBy("downstream_doc").orderBy(*order))})
    rest = _height(("upstream_content", 70), ("evidence", 48), ("ai_opinion", 48))
    own = F.greatest(F.lit(LEAST_HEIGHT), _height(("downstream_content", 55)) / F.col("rows_of_unit"))
    scored = F.when((F.col("relation_source") != "table") & (F.col("candidate_score") > 0), F.round("candidate_score", 2))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    columns = [F.col("number"), *map(text, ("downstream_id", "downstream_content", "upstream_doc", "upstream_ref", "upstream_content", "downstream_doc", "relation_source")), scored, text("evidence"), F.when(F.col("ambiguous"), "待人工确认").otherwise(""), text("ai_opinion")]
    return placed.select(*(c.alias(name) for c, name in zip(columns, BACKWARD_COLUMNS, strict=True)), "seq", "rows_of_unit", "place", F.greatest(own, rest).alias("height"), "down_runs", "up_runs")


def united_runs(text: str, colourings: Iterable[Iterable[dict]]) -> list[dict]:
    """[A6] One text's colourings as runs of each character's highest class."""
    levels = [0] * len(text)
    for runs in colourings:
        at = 0
        for run in runs:
            level = CLASSES.index(run["category"])
            for i in range(at, min(at + len(run["text"]), len(text))):
                levels[i] = max(levels[i], level)
            at += len(run["text"])
    stretches = groupby(range(len(text)), key=levels.__getitem__)
    return [{"text": "".join(text[i] for i in places), "category": CLASSES[level]} for level, places in stretches]


def backward_workbooks(rows: DataFrame) -> DataFrame:
    """[K1, K11] A workbook for each downstream document: ``downstream_doc``, ``sheet``, ``content``.

    A unit of several rows has its first three cells merged, its content coloured by the union of all its
    rows. Executors make the files; a sheet holds 1,048,576 rows at most, so a document has no more either.
    """

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("序号")
        body, merged = [], []
        for _, unit in frame.groupby("seq", sort=False):
            first = len(body) + 2
            colourings = [r for r in unit["down_runs"] if r is not None]
            for i, row in enumerate(unit.to_dict("records")):
                cells = [None if isinstance(row[c], float) and row[c] != row[c] else row[c] for c in BACKWARD_COLUMNS]
                if i:
                    cells[:3] = "", "", ""
                elif colourings:
                    cells[2] = united_runs(cells[2], colourings)
                if row["up_runs"] is not None:
                    cells[5] = list(row["up_runs"])
                body.append(cells)
            if len(unit) > 1:
                merged += [f"{letter}{first}:{letter}{len(body) + 1}" for letter in "ABC"]
        sheet = frame["sheet"].iloc[0]
        data = workbook({sheet: (BACKWARD_COLUMNS, body)}, {sheet: BACKWARD_WIDTHS}, {sheet: list(frame["height"])}, {sheet: merged})
        return pd.DataFrame({"downstream_doc": [frame["下游文档"].iloc[0]], "sheet": [sheet], "content": [data]})

    shown = backward_rows(rows).withColumn("sheet", T.sheet_name(F.col("下游文档")))
    return shown.groupBy("下游文档").applyInPandas(made, "downstream_doc string, sheet string, content binary")


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """[K5] A JSON text for each key."""
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c != key))))).alias("json"))


def as_markdown(blocks: DataFrame) -> DataFrame:
    """[K5] Documents as Markdown: headings by level, list items, paragraphs."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("kind") == "list", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("page", "order", line.alias("line"))))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("markdown"))


def html_runs(runs: Column, most: int = 300) -> Column:
    """[K8] Coloured runs as HTML; runs that begin after ``most`` characters are left out."""
    colour = lambda c: F.when(c == "GREEN", f"#{COLOURS['GREEN']}").when(c == "BLUE", f"#{COLOURS['BLUE']}").otherwise(f"#{COLOURS['BLACK']}")
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("n"))

    def add(state: Column, run: Column) -> Column:
        span = F.concat(F.lit('<span style="color:'), colour(run["category"]), F.lit('">'), T.html_escaped(run["text"]), F.lit("</span>"))
        return F.struct(F.when(state["n"] <= most, F.concat(state["html"], span)).otherwise(state["html"]).alias("html"), (state["n"] + F.length(run["text"])).alias("n"))

    return F.aggregate(runs, start, add)["html"]


def _escaped(text: str) -> str:
    """Text for XML, which has no place for control characters."""
    return escape(re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF\uFFFE\uFFFF]", "", text))


def _cell(ref: str, value: object) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if isinstance(value, list):
        runs = "".join(f'<r><rPr><color rgb="FF{COLOURS[r["category"]]}"/></rPr><t xml:space="preserve">{_escaped(r["text"])}</t></r>' for r in value)
        return f'<c r="{ref}" t="inlineStr"><is>{runs}</is></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_escaped(str(value or ""))}</t></is></c>'


def workbook(sheets: dict[str, tuple[Iterable[str], Iterable[Iterable[object]]]], widths: dict[str, Iterable[float]] = {}, heights: dict[str, list[float]] = {}, merged: dict[str, list[str]] = {}) -> bytes:
    """[K1, K2, K11] A workbook's bytes: for each sheet's name, its headers and rows; a list of runs makes a coloured cell.

    By sheet as well: widths of columns, heights of the rows below the headers, and merged ranges.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            headers, rows = sheets[name]
            tall = ["", *(f' ht="{h:g}" customHeight="1"' for h in heights.get(name, ()))]
            lines = [list(headers), *rows]
            body = "".join(f'<row r="{r}"{tall[r - 1] if r <= len(tall) else ""}>' + "".join(_cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(lines, 1))
            columns = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths.get(name, ()), 1))
            joined = "".join(f'<mergeCell ref="{ref}"/>' for ref in merged.get(name, ()))
            cols, merges = f"<cols>{columns}</cols>" if columns else "", f'<mergeCells count="{len(merged[name])}">{joined}</mergeCells>' if joined else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}">{cols}<sheetData>{body}</sheetData>{merges}</worksheet>')
    return out.getvalue()


def write_verdicts(answers: DataFrame, path: str) -> None:
    """[K9] Append fresh answers to the cache."""
    answers.filter("answer is not null and not cached").select("cache_key", "answer", F.current_timestamp().alias("written")).write.mode("append").parquet(path)


def dump_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """[K7] Write a stage's rows and go on from what was written."""
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")
    return df.sparkSession.read.parquet(f"{folder}/{stage}")


def output_name(base: str, now: datetime | None = None) -> str:
    """[K10] A file name with the time before its ending."""
    stem, dot, ending = base.rpartition(".")
    return f"{stem or ending}_{(now or datetime.now()):%Y%m%d_%H%M%S}{dot}{ending if stem else ''}"

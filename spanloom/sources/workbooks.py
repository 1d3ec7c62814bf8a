"""Saved workbooks as tables: cells with their coloured runs, and the rows of a backward matrix in them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.matrix import category_of, dominant

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Default theme colours that are no black, and the columns of a backward sheet.
THEME_COLOURS = {0: "FFFFFF"}
LETTERS = {"B": "downstream_id", "C": "downstream_content", "D": "upstream_doc", "E": "upstream_ref", "F": "upstream_content", "G": "downstream_doc"}
_CELL = "path string, sheet string, row_no int, letter string, runs array<struct<text:string,colour:string>>"


def _colour(element: ElementTree.Element | None) -> str:
    found = None if element is None else element.find(f"{_MAIN}color")
    if found is None:
        return ""
    return found.get("rgb") or THEME_COLOURS.get(int(found.get("theme") or -1), "")


def _runs(element: ElementTree.Element, plain: str = "") -> list[dict]:
    """Text and colour of each run; a text without runs has the colour ``plain``."""
    text = lambda e: "" if (t := e.find(f"{_MAIN}t")) is None else t.text or ""
    listed = element.findall(f"{_MAIN}r")
    return [{"text": text(r), "colour": _colour(r.find(f"{_MAIN}rPr"))} for r in listed] or [{"text": text(element), "colour": plain}]


def read_cells(content: bytes) -> list[tuple[str, int, str, list[dict]]]:
    """Sheet file, row, column letter and runs of each cell that is not empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
        styles, strings = part("xl/styles.xml"), part("xl/sharedStrings.xml")
        fonts = [] if styles is None else [_colour(f) for f in styles.findall(f"{_MAIN}fonts/{_MAIN}font")]
        by_style = [] if styles is None else [fonts[i] if (i := int(x.get("fontId") or 0)) < len(fonts) else "" for x in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]
        shared = [] if strings is None else strings.findall(f"{_MAIN}si")
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet.*\.xml", n)):
            for cell in part(name).iter(f"{_MAIN}c"):
                letter, row = re.match(r"([A-Z]+)(\d+)", cell.get("r") or "A0").groups()
                style = int(cell.get("s") or 0)
                plain = by_style[style] if style < len(by_style) else ""
                value, inline = cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                if inline is not None:
                    runs = _runs(inline, plain)
                elif value is None or not value.text:
                    continue
                elif cell.get("t") == "s":
                    runs = _runs(shared[int(value.text)], plain) if int(value.text) < len(shared) else []
                else:
                    runs = [{"text": value.text, "colour": plain}]
                if any(run["text"] for run in runs):
                    out.append((name, int(row), letter, runs))
    return out


def workbook_cells(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[S6, S7] Cells of workbooks ``path``, ``content``, each run with its class; and, apart from them, files that cannot be read.

    Returns ``path``, ``sheet``, ``row_no``, ``letter``, ``text``, ``runs`` (text and category), ``category``; and ``path``, ``error``.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *cell, None) for cell in read_cells(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "letter", "runs", "error"]).astype({"row_no": "Int32"})

    found = files.select("path", "content").mapInPandas(read, _CELL + ", error string")
    coloured = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), category_of(F.when(r["colour"] == "", "000000").otherwise(r["colour"])).alias("category")))
    size = lambda kind: F.aggregate(F.filter("runs", lambda r: r["category"] == kind), F.lit(0), lambda t, r: t + F.length(r["text"]))
    cells = found.filter("error is null").select("path", "sheet", "row_no", "letter", coloured.alias("runs"))
    cells = cells.select("path", "sheet", "row_no", "letter", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), "runs", dominant(size("GREEN"), size("BLUE")).alias("category"))
    return cells, found.filter("error is not null").select("path", "error")


def saved_rows(cells: DataFrame) -> DataFrame:
    """[S6] Rows of saved backward matrices: those of merged cells get the downstream unit above, rows without a reference go.

    A unit is remembered where both its id and its content stand; a row without an id takes both, one
    with an id but without content takes the content.
    """
    cell = F.struct("text", "runs", "category")
    wide = cells.filter("row_no > 1").groupBy("path", "sheet", "row_no").agg(*(F.first(F.when(F.col("letter") == letter, cell), ignorenulls=True).alias(name) for letter, name in LETTERS.items()))
    text = lambda name: F.coalesce(F.col(f"{name}.text"), F.lit(""))
    order = Window.partitionBy("path", "sheet").orderBy("row_no")
    whole = (text("downstream_id") != "") & (text("downstream_content") != "")
    kept = F.last(F.when(whole, F.struct("downstream_id", "downstream_content")), ignorenulls=True).over(order)
    rows = wide.withColumn("_kept", kept)
    nameless, silent = text("downstream_id") == "", text("downstream_content") == ""
    told = F.col("_kept").isNotNull()
    own = F.when(nameless & told, F.col("_kept.downstream_id.text")).otherwise(text("downstream_id"))
    content = F.when((nameless | silent) & told, F.col("_kept.downstream_content")).otherwise(F.col("downstream_content"))
    shown = rows.withColumns({"downstream_id": own, "downstream_content": content}).filter(text("upstream_ref") != "")
    return shown.select("path", "sheet", "row_no", "downstream_id", text("downstream_content").alias("downstream_content"), F.col("downstream_content.runs").alias("down_runs"), *(text(n).alias(n) for n in ("downstream_doc", "upstream_doc", "upstream_ref", "upstream_content")), F.col("upstream_content.runs").alias("up_runs"), F.coalesce("upstream_content.category", F.lit("BLACK")).alias("up_category"))

"""From document text to identified units: items, sections, filters on them, and document types.

Inputs have a row for each document: ``doc`` and ``text``. Survey ids stand in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

# Fixed values of the extraction rules.
TRACE_ROW = r"^<[^>]+>[ \t]*<[^>]+>|^(?:追踪|引用|对应|来源|上游|关联)[一-鿿]{0,20}(?:用户需求|系统需求|上游文件|本条|该条|来源文件)"
TABLE_START = r"^\s*(?:附表|表\s*\d+|序号|本文档中的|需求标志|追踪|编号)\s*"
TABLE_HEADER_LINE = r"(?m)^\s*(?:附表\s*\d*[^\n]*需求追踪[表合]?|附表\s*\d*[ \t]*|需求追踪[表合]?[ \t]*|序号[ \t]*|本文档中的[^\n]*|需求标志[^\n]*|对应关系[表]?[ \t]*|追踪[^\n]*表[^\n]*)\s*$"
SECTION_LINE = r"(?m)^(\d+(?:\.\d+)*\.?)\s*([一-鿿A-Z][^\n]*)"
CONTENTS_LINE = r"^(?:\d+(?:\.\d+)*\.?)\s*[一-鿿A-Za-z].{0,40}?(?:(?:\.{2,}|[ \t]{2,})\s*\d+(?:-\d+)?[ \t]*)$"
GENERIC_TITLES = "概述|要求|功能|描述|简介|综述|规则|准则|说明|意义|目的|范围|组成|结构|原理|故障诊断|模块类|系统级|总体|通用"
DIAGRAM_SIGNS = "[│├└┌┐┘┬┴┼─┤╔╗╚╝║═╠╣╦╩╬→←↑↓▲▼►◄]"
LISTED_LINE = r"^\s*(?:[-•●·○■□►◆]\s*|\d+[)）.]\s*|[a-zA-Z][)）]\s*)"
_HEADING = r"(?:\d+(?:\.\d+)+\.?[ \t]*[一-鿿A-Za-z].{0,40}|\d+(?:\.\d+)+\.?[ \t]*(?=\n)|\d+\.?[ \t]+[一-鿿A-Za-z].{0,40}|[一-鿿]{2,25}[（(][A-Za-z][A-Za-z0-9/\-,]*[)）])"
TRAILING_HEADINGS = rf"\n+{_HEADING}(?:\n+{_HEADING})*\s*$"
TRAILING_SUBTITLE = r"(?:\n+|(?<=[。．.]))[一-鿿]{2,20}[（(][A-Za-z][A-Za-z0-9/\-,]*[)）]\s*$"
TRAILING_APPENDIX = r"(?s)(?:\n+|(?<=[。\n]))(?:\d+[)）]\s*)?(?:附录[A-Za-z\d]|下表[A-Za-z]所示|需求追踪关?系|本文件与上游文件|追踪关系间?[下间]).*$"


def document_type(docs: DataFrame, least: int = 3) -> DataFrame:
    """``id_based`` if at least ``least`` distinct ids occur, else ``chapter_based``."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(T.ITEM_ID), F.lit(0)), T.normal_id))
    return docs.select("doc", F.size(ids).alias("n_ids"), F.when(F.size(ids) >= least, "id_based").otherwise("chapter_based").alias("doc_type"))


def _noise_lines(lines: Column) -> Column:
    """Lines that look like labels of a drawing rather than prose."""

    def noisy(line: Column) -> Column:
        s = T.strip(line)
        cjk = F.length(F.regexp_replace(s, f"[^{T.CJK}]", ""))
        short_words = F.size(F.filter(F.split(s, r"\s+"), lambda w: (F.length(w) > 0) & (F.length(w) <= 8)))
        label = (cjk == 0) & (F.length(s) <= 30) & s.rlike(r"^[>=<]|[A-Z]{2,}[-\d]|\d-[A-Z]")
        sparse = (cjk * 10 < F.length(s)) & (F.length(s) > 5) & (short_words >= 3)
        return (s != "") & (s.rlike(DIAGRAM_SIGNS) | ((F.length(s) >= 3) & (label | sparse)))

    return F.transform(lines, noisy)


def without_drawings(text: Column) -> Column:
    """[N17] Text without lines of drawings, if they are three or more, or a third of a longer text."""
    lines = F.split(text, "\n")
    flags = _noise_lines(lines)
    noise = F.size(F.filter(flags, lambda x: x))
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("l"), flags.alias("f")), lambda p: ~p["f"]), lambda p: p["l"]), "\n")
    many = (noise >= 3) | ((noise > 0) & (noise > 0.30 * F.size(lines)) & (F.length(F.replace(text, F.lit("\n"), F.lit(""))) > 100))
    return F.when((F.size(lines) >= 3) & many, kept).otherwise(text)


def _cut_tail(text: Column, pattern: str, below: int) -> Column:
    tail = F.regexp_extract(text, pattern, 0)
    return F.when((tail != "") & (F.length(T.strip(tail)) < below), F.substring(text, F.lit(1), F.length(text) - F.length(tail))).otherwise(text)


def staged(df: DataFrame, column: str, *steps) -> DataFrame:
    """Steps on a column one projection after another, so that each reads the value before, not its whole expression again.

    The last step is the identity by way of a generator: filters on the result would else be pushed
    below all steps, each of which multiplies their expression.
    """
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df.withColumn(column, F.explode(F.array(column)))


def _lines_only(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: s != ""), "\n")


#: [N17] Stripped lines; enumerations on lines of their own; no drawings, trailing headings or appendix notes.
CLEANING = (
    _lines_only,
    lambda t: F.regexp_replace(t, r"；\s*(?=\d+[)）])", "；\n"),
    without_drawings,
    lambda t: _cut_tail(t, TRAILING_HEADINGS, 60),
    lambda t: _cut_tail(t, TRAILING_SUBTITLE, 60),
    lambda t: _cut_tail(t, TRAILING_APPENDIX, 200),
    T.strip,
)


def without_title_line(text: Column) -> Column:
    """[N18] Text without a short first line that is numbered or generic."""
    lines = F.split(text, "\n")
    first = T.strip(lines[0])
    short = (F.length(first) <= 15) & ~first.rlike("[。；！？]") & ~first.rlike("[：:]$")
    titled = first.rlike(r"^\d+(\.\d+)*[.、]?\s*") | first.rlike(GENERIC_TITLES)
    return F.when((F.size(lines) >= 2) & short & titled, T.strip(F.array_join(F.slice(lines, 2, F.size(lines) - 1), "\n"))).otherwise(text)


def is_noise_item(content: Column) -> Column:
    """Whether what follows an id is a row of a table rather than a requirement."""
    unfinished = (F.length(content) <= 30) & ~content.rlike("[。；！？]$")
    return content.rlike(TRACE_ROW) | content.rlike("<[^>]+>") | content.rlike(TABLE_START) | unfinished


def without_table(content: Column) -> Column:
    """[A.3] Content up to the first line that heads a relation table."""
    before = F.split(content, TABLE_HEADER_LINE, 2)[0]
    return F.when(F.length(before) < F.length(content), F.regexp_replace(before, r"(?U)\s+$", "")).otherwise(content)


def sliced(docs: DataFrame, pattern: str) -> DataFrame:
    """[W2] Each match of a pattern and the text up to the next: ``doc``, ``ord``, ``found``, ``content``."""
    pieces = F.split(F.col("text"), pattern)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    both = F.arrays_zip(found.alias("found"), F.slice(pieces, 2, F.size(found)).alias("content"))
    return docs.filter(F.size(found) > 0).select("doc", F.posexplode(both).alias("ord", "m")).select("doc", "ord", "m.found", "m.content")


def merged_lines(parts: Column) -> Column:
    """[A3] Distinct stripped non-empty lines of several texts, in order of appearance."""
    lines = F.flatten(F.transform(parts, lambda p: F.split(p, "\n")))
    return F.array_join(F.array_distinct(F.filter(F.transform(lines, T.strip), lambda s: s != "")), "\n")


def upper_median_filter(units: DataFrame, partition: list[str], length: str, share: float = 0.15, least: float = 20, more_than: int = 5) -> DataFrame:
    """Keep rows whose ``length`` reaches the larger of ``least`` and a share of the upper median; groups up to ``more_than`` stay whole.

    The median is the element at half the number of rows, counted from 0 in ascending order.
    """
    w = Window.partitionBy(*partition)
    ranked = units.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(length)) - 1})
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col(length))).over(w)
    return ranked.withColumn("median_length", median).filter((F.col("_n") <= more_than) | (F.col(length) >= F.greatest(F.lit(float(least)), share * F.col("median_length")))).drop("_n", "_r")


def truncated_noise(content: Column, median: Column) -> Column:
    """A far too long content up to the third line in a row without CJK characters."""
    lines = F.split(content, "\n")

    def step(state: Column, line: Column) -> Column:
        s = T.strip(line)
        cjk = F.length(F.regexp_replace(s, f"[^{T.CJK}]", ""))
        foreign = (s == "") | (cjk * 10 < F.length(s))
        run = F.when(foreign, state["run"] + 1).otherwise(0)
        hit = (run >= 3) & (s != "") & state["cut"].isNull()
        return F.struct((state["at"] + 1).alias("at"), run.alias("run"), F.when(hit, state["at"] + 1 - run).otherwise(state["cut"]).alias("cut"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(None).cast("int").alias("cut"))
    cut = F.aggregate(lines, start, step)["cut"]
    shorter = T.strip(F.array_join(F.slice(lines, F.lit(1), F.greatest(cut, F.lit(0))), "\n"))
    long = (F.length(content) > 8 * median) & (F.length(content) > 500)
    return F.when(long & cut.isNotNull() & (F.length(shorter) >= 30), shorter).otherwise(content)


def items(docs: DataFrame) -> DataFrame:
    """[F2-F4, A3, W2, N17, N18] Requirement items: ``doc``, ``ord``, ``item_id``, ``raw_id``, ``content``.

    An id's occurrences merge into one item at its first kept place; a single one keeps its text.
    """
    cut = sliced(docs, T.ITEM_ID).select("doc", "ord", T.normal_id(F.col("found")).alias("item_id"), F.col("found").alias("raw_id"), "content")
    cut = staged(cut, "content", *CLEANING, without_title_line)
    kept = cut.filter(~is_noise_item(F.col("content"))).withColumn("content", without_table(F.col("content")))
    grouped = kept.groupBy("doc", "item_id").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "raw_id", "content"))).alias("parts"))
    content = F.when(F.size("parts") == 1, F.col("parts")[0]["content"]).otherwise(merged_lines(F.transform("parts", lambda p: p["content"])))
    one = grouped.select("doc", "ord", "item_id", F.element_at("parts", -1)["raw_id"].alias("raw_id"), content.alias("content")).withColumn("_len", F.length("content"))
    count = F.count("*").over(Window.partitionBy("doc"))
    kept = upper_median_filter(one.withColumn("_count", count), ["doc"], "_len")
    return kept.select("doc", "ord", "item_id", "raw_id", F.when(F.col("_count") > 5, truncated_noise(F.col("content"), F.col("median_length"))).otherwise(F.col("content")).alias("content"))


def sections(docs: DataFrame) -> DataFrame:
    """[F5, W2] Numbered sections: ``doc``, ``ord``, ``section_number``, ``section_title``, ``content``, ``full_key``.

    A section ends at the next heading of any level. Lines of a table of contents are no headings.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    # a number alone on its line is completed by the next line that begins like a title
    following = F.lead("line").over(Window.partitionBy("doc").orderBy("ord"))
    lines = lines.withColumn("after", following)
    whole = F.regexp_extract("line", r"^(\d+(?:\.\d+)*\.?)[ \t]*([一-鿿A-Z].*)$", 1)
    alone = F.regexp_extract("line", r"^(\d+(?:\.\d+)*\.?)[ \t]*$", 1)
    split = (whole == "") & (alone != "") & F.col("after").rlike(r"^[ \t]*[一-鿿A-Z]")
    marked = lines.select(
        "doc", "ord", "line",
        F.when(F.col("line").rlike(CONTENTS_LINE), None).when(whole != "", whole).when(split, alone).alias("number"),
        F.when(whole != "", F.regexp_extract("line", r"^(\d+(?:\.\d+)*\.?)[ \t]*([一-鿿A-Z].*)$", 2)).when(split, F.col("after")).alias("title"),
        split.alias("split"),
    )
    order = Window.partitionBy("doc").orderBy("ord")
    titled = F.coalesce(F.lag("split").over(order) & F.lag("number").over(order).isNotNull(), F.lit(False))
    placed = marked.withColumn("titled", titled).withColumn("section", F.count("number").over(order)).filter("section > 0")
    body = F.when(F.col("number").isNull() & ~F.col("titled"), F.struct("ord", "line"))
    grouped = placed.groupBy("doc", "section").agg(F.min("ord").alias("ord"), F.max("number").alias("section_number"), F.max(F.when(F.col("number").isNotNull(), T.strip(F.col("title")))).alias("section_title"), F.sort_array(F.collect_list(body)).alias("body"))
    content = F.array_join(F.transform("body", lambda b: b["line"]), "\n")
    rows = grouped.select("doc", "ord", "section_number", "section_title", content.alias("content"), F.concat("section_number", "section_title").alias("full_key"))
    return staged(rows, "content", *CLEANING)


def monotonic_skeleton(rows: DataFrame, partition: list[str], order: str, number: str) -> DataFrame:
    """Rows whose number exceeds all before it in order; numbers that are empty arrays go.

    The last kept row always holds the largest number so far, so a running maximum decides.
    """
    before = F.max(number).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    told = rows.filter(F.col(number).isNotNull() & (F.size(number) > 0)) if dict(rows.dtypes)[number].startswith("array") else rows.filter(F.col(number).isNotNull())
    return told.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(number) > F.col("_before"))).drop("_before")


def units(docs: DataFrame, role: str = "upstream") -> DataFrame:
    """[F6, U1, P2] Units of documents: ``doc``, ``kind``, ``key``, ``content``, ``ord``.

    Upstream documents give items and sections; downstream ones items if they are based on ids, else sections.
    """
    found = items(docs).filter(F.length(T.strip(F.col("content"))) >= 8).select("doc", F.lit("item").alias("kind"), F.col("item_id").alias("key"), "content", "ord")
    numbered = sections(docs).withColumn("number", T.section_numbers(F.col("section_number")))
    skeleton = monotonic_skeleton(numbered, ["doc"], "ord", "number").filter(F.length(T.strip(F.col("content"))) >= 30)
    key = F.substring(T.strip(F.concat_ws(" ", "section_number", "section_title")), 1, 60)
    parts = skeleton.select("doc", F.lit("section").alias("kind"), key.alias("key"), "content", (F.col("ord") + 1_000_000).alias("ord"))
    both = found.unionByName(parts)
    if role == "upstream":
        return both
    wanted = F.when(F.col("doc_type") == "id_based", "item").otherwise("section")
    return both.join(document_type(docs).select("doc", "doc_type"), "doc").filter(F.col("kind") == wanted).drop("doc_type")


def repeated_lines(lines: DataFrame, group: list[str], page: str, line: str, share: float = 0.35, span: float = 0.7, most: int = 60) -> DataFrame:
    """[F8] Short lines that recur over a group's pages, as running heads do: ``group``, ``line``, ``pages``. List items, ids and sentences don't count."""
    pages = lines.groupBy(*group).agg(F.countDistinct(page).alias("n"), (F.max(page) - F.min(page)).alias("extent"))
    plain = ~F.col(line).rlike(LISTED_LINE) & ~F.col(line).rlike(T.ITEM_ID) & ~F.col(line).rlike("[。！？；，、]$")
    short = lines.filter((F.length(line) <= most) & (F.length(line) > 0) & plain)
    seen = short.groupBy(*group, line).agg(F.countDistinct(page).alias("pages"), (F.max(page) - F.min(page)).alias("reach"))
    enough = (F.col("n") >= 3) & (F.col("pages") >= F.greatest(F.lit(3), F.floor(share * F.col("n")))) & (F.col("reach") >= F.greatest(F.lit(1), F.floor(span * F.col("n"))))
    return seen.join(pages, group).filter(enough).select(*group, line, "pages")


def without_repeated_lines(lines: DataFrame, group: list[str], page: str, line: str, **limits: float) -> DataFrame:
    """[F8] The lines without those that recur."""
    return lines.join(repeated_lines(lines, group, page, line, **limits).select(*group, line), [*group, line], "left_anti")


def repeated_in_band(lines: DataFrame, share: float = 0.35, band: float = 20.0) -> DataFrame:
    """Texts that recur at about the same height of a document's pages: ``doc``, ``text``."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("n"))
    seen = lines.groupBy("doc", "text").agg(F.count("*").alias("times"), (F.max("y0") - F.min("y0")).alias("spread"))
    return seen.join(pages, "doc").filter((F.col("times") >= F.greatest(F.lit(3), F.floor(share * F.col("n")))) & (F.col("spread") <= band)).select("doc", "text")


def without_edge_block(text: Column, keywords: list[str], first: int = 8, last: int = 5, most: int = 30) -> Column:
    """Text without short lines of head or foot that hold a keyword."""
    lines = F.split(text, "\n")
    pattern = "|".join(keywords)

    def keep(line: Column, i: Column) -> Column:
        edge = (i < first) | (i >= F.size(lines) - last)
        return ~(edge & (F.length(T.strip(line)) <= most) & line.rlike(pattern))

    return F.array_join(F.filter(lines, keep), "\n")


def full_text(pages: DataFrame) -> DataFrame:
    """[S2] A document's pages in order, joined by line feeds."""
    parts = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def list_marks(lines: DataFrame) -> DataFrame:
    """[N23, N25] Lines with the sort of their list mark, and the depth of a heading number."""
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+)*)\.?\s*[一-鿿A-Za-z]", 1)
    return lines.withColumn("marker", T.marker_kind(F.col("line"))).withColumn("heading_depth", F.when(number != "", F.size(F.split(number, r"\.")))) 

"""Queries of the document operators: texts made of the driver's tables in the form that the rules expect, and what must come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vector as V
from spanloom.operators import discovery, forward, matrix, relations, units
from spanloom.options import DiscoveryOptions
from spanloom.plans.registry import NORMAL, long, query, six
from spanloom.sources.readers import table

_LINE = "ORDER BY doc, ord"


def _joined(rows: DataFrame, order: str, line) -> DataFrame:
    """Documents whose texts are lines in an order."""
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda p: p["l"]), "\n").alias("text"))


# ---- documents and units ----------------------------------------------------------------------


@query("SELECT conv_id AS doc, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def full_text(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_number"), "text")
    return units.full_text(pages).select("doc", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _order_text():
    """A requirement for each order; those that are open say less, finished ones come again with a further line."""
    said = F.concat(F.lit("系统应在处理订单"), "o_orderkey", F.lit("时按优先级"), F.substring("o_orderpriority", 3, 20), F.lit("执行，并记录结果。"))
    return F.when(F.col("o_orderstatus") == "O", F.lit("记录订单并归档。")).otherwise(said)


def _order_docs(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    name = F.concat(F.lit("< ORD-"), F.col("o_orderkey").cast("string"), F.lit(">\n"))
    once = orders.select("doc", F.col("o_orderkey").alias("ord"), F.concat(name, _order_text()).alias("line"))
    again = orders.filter("o_orderstatus = 'F'").select("doc", (F.col("o_orderkey") + 10**9).alias("ord"), F.concat(name, _order_text(), F.lit("\n补充说明应当保存。")).alias("line"))
    return _joined(once.unionByName(again), "ord", F.col("line"))


_ORDER_ITEMS = """items AS (SELECT o_custkey AS doc, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, '<ORD-' || o_orderkey || '>' AS item_id,
 CASE WHEN o_orderstatus = 'O' THEN '记录订单并归档。' ELSE '系统应在处理订单' || o_orderkey || '时按优先级' || substring(o_orderpriority, 3, 20) || '执行，并记录结果。' END || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '补充说明应当保存。' ELSE '' END AS content FROM orders),
 kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n, list(length(content)) OVER (PARTITION BY doc) AS l FROM items) WHERE n <= 5 OR length(content) >= greatest(20, 0.15 * list_sort(l)[(n // 2) + 1]))"""


@query(f"WITH {_ORDER_ITEMS} SELECT doc, ord, item_id, content FROM kept")
def item_units(spark, sf_dir):
    return units.items(_order_docs(spark, sf_dir)).select("doc", "ord", "item_id", "content")


def _section_docs(spark, sf_dir) -> DataFrame:
    """Customers as numbered sections of nations, with a line of contents before each, and headings of tables whose numbers run back."""
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), "c_custkey", "c_name", "c_mktsegment", at.alias("i"))
    number = F.concat(F.floor(F.col("i") / 10) + 1, F.lit("."), F.col("i") % 10 + 1)
    back = F.when(F.col("i") % 7 == 6, F.concat(F.lit("\n1.1 表格"), F.col("i"), F.lit("\n本表列出的内容只供参考使用，与正文的要求没有关系，也不是需求条目。"))).otherwise("")
    body = F.concat(number, F.lit(" 客户"), "c_name", F.lit(" .... 3\n"), number, F.lit(" 客户"), "c_name", F.lit("\n该客户的账户应按"), "c_mktsegment", F.lit("类业务核对并存档备查，正文的长度不少于三十个字。"), back)
    return _joined(rows, "c_custkey", body)


_SECTIONS = """raw AS (SELECT c_nationkey AS doc, c_custkey AS k, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
 sec AS (SELECT doc, k, 0 AS part, (i // 10 + 1) AS a, (i % 10 + 1) AS b, '客户' || c_name AS title, '该客户的账户应按' || c_mktsegment || '类业务核对并存档备查，正文的长度不少于三十个字。' AS content FROM raw
  UNION ALL SELECT doc, k, 1, 1, 1, '表格' || i, '本表列出的内容只供参考使用，与正文的要求没有关系，也不是需求条目。' FROM raw WHERE i % 7 = 6)"""


@query(f"WITH {_SECTIONS} SELECT doc, a || '.' || b AS section_number, title AS section_title, content FROM sec")
def section_units(spark, sf_dir):
    return units.sections(_section_docs(spark, sf_dir)).select("doc", "section_number", "section_title", "content")


@query(f"""WITH {_SECTIONS}, m AS (SELECT *, max(a * 100000 + b) OVER (PARTITION BY doc ORDER BY k, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sec)
SELECT doc, 'section' AS kind, substring(a || '.' || b || ' ' || title, 1, 60) AS "key", length(content) AS chars FROM m WHERE before IS NULL OR a * 100000 + b > before""")
def downstream_units(spark, sf_dir):
    return units.units(_section_docs(spark, sf_dir), "downstream").select("doc", "kind", "key", long(F.length("content")).alias("chars"))


_EDGE = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, len(l) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT ((i < 8 OR i >= n - 5) AND length(trim(line)) <= 30 AND regexp_matches(line, 'the|license|[0-9]'))), '')) AS text_md5 FROM {_EDGE} GROUP BY doc_id""")
def edge_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(units.without_edge_block(F.col("text"), ["the", "license", "[0-9]"]).cast("binary")).alias("text_md5"))


@query("""SELECT user_id AS doc, event_type AS text FROM (SELECT user_id, event_type, count(*) AS times, max(value) - min(value) AS spread FROM events GROUP BY user_id, event_type) JOIN (SELECT user_id, count(DISTINCT event_id % 20) AS n FROM events GROUP BY user_id) USING (user_id) WHERE times >= greatest(3, floor(0.35 * n)) AND spread <= 20""")
def band_repeats(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 20).alias("page"), F.col("event_type").alias("text"), F.col("value").alias("y0"))
    return units.repeated_in_band(lines)


# ---- text rules -------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN t || '模块组' WHEN length(t) + 2 > 10 THEN t ELSE t || '功能' END AS clean FROM (SELECT p_partkey, p_size, p_name AS t FROM part)""")
def purified_phrases(spark, sf_dir):
    """Part names with a number before and signs after; every other one with a generic last word, which goes from long names."""
    phrase = F.concat(F.lit(" "), F.col("p_size"), F.lit(") "), "p_name", F.when(F.col("p_size") % 2 == 0, "功能").otherwise("模块组"), F.lit("；。 "))
    return table(spark, sf_dir, "part").select("p_partkey", T.purified(phrase).alias("clean"))


@query("""SELECT p_partkey, list_concat(['DCS-' || p_partkey], ['停堆', '堆保', '保护', '定期', '期试', '试验']) AS tokens FROM part""")
def technical_tokens(spark, sf_dir):
    text = F.concat(F.lit("停堆保护 dcs-"), "p_partkey", F.lit("，定期试验。"))
    return table(spark, sf_dir, "part").select("p_partkey", T.tokens(text).alias("tokens"))


@query("""SELECT p_partkey, [p_name, p_brand, p_type || '：见下'] AS items FROM part""")
def anchor_items(spark, sf_dir):
    text = F.concat(F.lit("- "), "p_name", F.lit("；\n ab \n3) "), "p_brand", F.lit("。\n"), "p_type", F.lit("：见下；;"))
    return table(spark, sf_dir, "part").select("p_partkey", T.list_items(text).alias("items"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 IN (1, 3, 4) THEN ['F-SC' || (p_size % 6), 'F-SC2'] ELSE ['F-SC2'] END AS codes FROM part""")
def class_code_sets(spark, sf_dir):
    text = F.concat(F.lit("f-sc "), F.col("p_size") % 6, F.lit(" 与 FSC2 级，F SC2"))
    return table(spark, sf_dir, "part").select("p_partkey", T.class_codes(text).alias("codes"))


@query("""SELECT p_partkey, '<' || p_brand || '-' || p_size || '>' AS id, [p_size // 10, p_size % 10] AS numbers, 'part' || p_partkey AS name FROM part""")
def ids_and_numbers(spark, sf_dir):
    raw = F.concat(F.lit(" <  "), "p_brand", F.lit("-"), "p_size", F.lit(" > "))
    number = F.concat(F.floor(F.col("p_size") / 10), F.lit("."), F.col("p_size") % 10, F.lit("."))
    path = F.concat(F.lit("dbfs:/a.b/c/part"), "p_partkey", F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_id(raw).alias("id"), T.section_numbers(number).alias("numbers"), T.document_name(path).alias("name"))


@query("""SELECT p_partkey, CASE WHEN length(t) <= 12 THEN t WHEN p_size % 3 = 0 THEN substring(t, 1, 9) WHEN p_size % 3 = 1 THEN substring(t, 1, 5) ELSE substring(t, 1, 12) END AS title FROM (SELECT p_partkey, p_size, p_name, substring(p_name, 1, CASE WHEN p_size % 3 = 0 THEN 6 ELSE 5 END) || CASE p_size % 3 WHEN 0 THEN '，系统：应当执行停堆' WHEN 1 THEN '，系统应当执行停堆' ELSE '系统应当执行停堆功能' END AS t FROM part)""")
def forward_titles(spark, sf_dir):
    cut = F.when(F.col("p_size") % 3 == 0, F.substring("p_name", 1, 6)).otherwise(F.substring("p_name", 1, 5))
    tail = F.when(F.col("p_size") % 3 == 0, "，系统：应当执行停堆").when(F.col("p_size") % 3 == 1, "，系统应当执行停堆").otherwise("系统应当执行停堆功能")
    return table(spark, sf_dir, "part").select("p_partkey", T.forward_title(F.concat(cut, tail)).alias("title"))


@query("""SELECT p_partkey, printf('语义%.2f 包含%.2f 稀有词%.2f 锚点%.2f', p_size / 63, p_size / 127, p_size / 251, p_size / 509) || CASE WHEN p_size % 2 = 0 THEN ' | 分级不符(下游F-SC1, F-SC2 vs 候选未声明)' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' | 锚点: ' || substring(p_name, 1, 20) || '、' || p_brand || '、b' ELSE '' END AS evidence FROM part""")
def channel_evidence(spark, sf_dir):
    s = F.col("p_size")
    hits = F.when(s % 3 == 0, F.array("p_name", F.concat(F.lit(" "), "p_brand"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    told = T.evidence(s / 63, s / 127, s / 251, s / 509, hits, s % 2 == 0, F.array(F.lit("F-SC2"), F.lit("F-SC1")), F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", told.alias("evidence"))


@query(r"""SELECT p_partkey, '系统，停堆' || chr(10) || '1)' || p_name || chr(10) AS page, p_name || chr(10) || p_brand AS cell FROM part""")
def page_and_cell_text(spark, sf_dir):
    page = F.concat(F.lit("系 统， 停\t堆\n 1) "), "p_name", F.lit("\n • \n"))
    cell = F.concat(F.lit("\n "), "p_name", F.lit(" \n\n"), "p_brand", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", T.page_text(F.regexp_replace(page, "(?m)^ (?=1)", "")).alias("page"), T.cell_text(cell).alias("cell"))


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'circled' WHEN 1 THEN 'number' WHEN 2 THEN 'chinese' WHEN 3 THEN 'letter' WHEN 4 THEN 'bullet' WHEN 5 THEN 'dash' END AS marker FROM part""")
def marker_kinds(spark, sf_dir):
    mark = F.get(F.array(*map(F.lit, ("③ ", "(12) ", "三、", "b) ", "■", "– ", ""))), F.col("p_size") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", T.marker_kind(F.concat(F.lit(" "), mark, "p_name")).alias("marker"))


# ---- relation tables and references -----------------------------------------------------------

_HEADERS = ["本文中的条目号", "上游文件章节", "文件说明"]


def _relation_tables(spark, sf_dir) -> DataFrame:
    """Line items as rows of relation tables: one table of two rows or more an order, on a page of its own of the supplier's document."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    own = F.when(F.col("l_linenumber") == F.min("l_linenumber").over(Window.partitionBy("l_orderkey")), F.concat(F.lit(" <ORD-"), "l_orderkey", F.lit("> "))).otherwise("")
    ref = F.concat(F.lit("<UP-"), "l_partkey", F.lit(">"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\n <UP-"), "l_suppkey", F.lit(">"))).otherwise(""))
    doc = F.concat(F.lit("文件"), F.col("l_suppkey") % 3, F.when(F.col("l_linenumber") % 4 == 0, "\n别的文件").otherwise(""))
    listed = rows.withColumns({"own": own, "cells": F.array(own, ref, doc)})
    made = listed.groupBy("doc", "l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "cells"))), lambda r: r["cells"]).alias("rows"))
    page = F.row_number().over(Window.partitionBy("doc").orderBy("l_orderkey"))
    return made.select("doc", page.alias("page_number"), F.lit(0).alias("ord"), F.array(*map(F.lit, _HEADERS)).alias("headers"), "rows", F.count("*").over(Window.partitionBy("doc")).alias("n_pages"))


_CELLS = """refs AS (SELECT l_orderkey % 50 AS doc, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS n_refs, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS n_docs, l_suppkey FROM lineitem),
 flat AS (SELECT doc, l_orderkey, rn, 0 AS cell, '<UP-' || l_partkey || '>' AS upstream_ref, '文件' || (l_suppkey % 3) AS upstream_doc FROM refs UNION ALL SELECT doc, l_orderkey, rn, 1, '<UP-' || l_suppkey || '>', CASE WHEN n_docs = 2 THEN '别的文件' ELSE '文件' || (l_suppkey % 3) END FROM refs WHERE n_refs = 2)"""


@query(f"""WITH {_CELLS} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY l_orderkey, rn, cell) - 1 AS ord, '<ORD-' || l_orderkey || '>' AS downstream_id, upstream_ref, upstream_doc FROM flat""")
def relation_tables(spark, sf_dir):
    """Tables on all pages, told by their headers, continued from page to page, their cells filled down and split."""
    tables = _relation_tables(spark, sf_dir)
    headed = relations.last_pages(tables, 10**6).filter(relations.is_relation_header(F.col("headers")))
    return relations.parsed_relations(relations.continued_tables(headed))


@query("""SELECT o % 50 AS doc, p AS page_number, n AS rows FROM (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) AS p, count(*) OVER (PARTITION BY l_orderkey % 50) AS pages, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE p > pages - 8 AND n >= 2""")
def last_sane_tables(spark, sf_dir):
    kept = relations.last_pages(relations.sane_tables(_relation_tables(spark, sf_dir)), 8)
    return kept.select("doc", long("page_number").alias("page_number"), long(F.size("rows")).alias("rows"))


@query("""WITH p AS (SELECT p_partkey % 20 AS doc, p_partkey AS k, p_size, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS i FROM part), f AS (SELECT doc, k, 0 AS cell, p_size FROM p UNION ALL SELECT doc, k, 1, p_size FROM p WHERE p_size % 2 = 0)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k, cell) - 1 AS ord, CASE WHEN max(CASE WHEN p_size % 3 <> 0 THEN k END) OVER w IS NULL THEN NULL ELSE '<DS-' || max(CASE WHEN p_size % 3 <> 0 THEN k END) OVER w || '>' END AS downstream_id, CASE WHEN cell = 0 THEN '<SYS-' || k || '>' ELSE '<SYS-' || p_size || '>' END AS upstream_ref, '系统需求' AS upstream_doc
FROM f WHERE (doc, k) NOT IN (SELECT doc, k FROM (SELECT doc, k, max(CASE WHEN p_size % 3 <> 0 THEN k END) OVER (PARTITION BY doc ORDER BY k) AS told FROM p) WHERE told IS NULL) WINDOW w AS (PARTITION BY doc ORDER BY k)""")
def design_relations(spark, sf_dir):
    """Parts as rows of design tables: an own id, left out in a third, and one or two ids of requirements."""
    own = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("< DS-"), "p_partkey", F.lit(">")))
    ref = F.concat(F.lit("见 <SYS-"), "p_partkey", F.lit(">"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" <SYS-"), "p_size", F.lit(">"))).otherwise(""))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("doc"), "p_partkey", F.array(ref, own).alias("cells"))
    made = rows.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "cells"))), lambda r: r["cells"]).alias("rows"))
    return relations.parsed_design_relations(made.withColumn("headers", F.array(F.lit("需求标志"), F.lit("设计条目"))))


@query("""WITH i AS (SELECT o_custkey AS doc, o_orderkey AS ord, '<ORD-' || o_orderkey || '>' AS id, 'c' || o_orderkey AS content FROM orders),
 r AS (SELECT o_custkey AS doc, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '<ORD-' || o_orderkey || '>' WHEN 'O' THEN 'ORD-' || (o_orderkey // 10) ELSE 'x<ORD-' || o_orderkey || '>y' END AS d FROM orders)
SELECT r.doc, o_orderkey, coalesce(any_value(e.content), arg_min(i.content, i.ord) FILTER (WHERE contains(i.id, d) OR contains(d, i.id)), '') AS downstream_content FROM r LEFT JOIN i e ON e.doc = r.doc AND e.id = d LEFT JOIN i ON i.doc = r.doc GROUP BY r.doc, o_orderkey""")
def joined_items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderstatus", F.concat(F.lit("<ORD-"), "o_orderkey", F.lit(">")).alias("item_id"))
    items = orders.select("doc", "item_id", F.concat(F.lit("c"), "o_orderkey").alias("content"), F.col("o_orderkey").alias("ord"))
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("< ORD-"), "o_orderkey", F.lit(" >"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("ORD-"), F.expr("o_orderkey div 10"))).otherwise(F.concat(F.lit("x<ORD-"), "o_orderkey", F.lit(">y")))
    return relations.joined_items(orders.select("doc", "o_orderkey", said.alias("downstream_id")), items).select("doc", "o_orderkey", "downstream_content")


@query("""WITH n AS (SELECT DISTINCT c_name || ' ' || n_name || '文件' AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT substring(n_name, 1, 4) FROM nation UNION SELECT n_name FROM nation), d AS (SELECT n_name AS doc, n_nationkey AS o FROM nation)
SELECT name, arg_min(doc, CASE WHEN replace(name, ' ', '') = replace(doc, ' ', '') THEN -1 ELSE o END) AS doc FROM n JOIN d ON contains(replace(name, ' ', ''), replace(doc, ' ', '')) OR contains(replace(doc, ' ', ''), replace(name, ' ', '')) GROUP BY name""")
def matched_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    longer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("c_name", F.lit(" "), "n_name", F.lit("文件")).alias("name"))
    names = longer.union(nation.select(F.substring("n_name", 1, 4))).union(nation.select("n_name"))
    return relations.matched_names(names, nation.select(F.col("n_name").alias("doc"), F.col("n_nationkey").alias("doc_ord")))


_KEYS = """p AS (SELECT p_brand AS doc, p_partkey AS ord, '<PRT-' || p_partkey || '>' AS id, p_size || '.' || p_partkey AS number, p_name AS title, 'text' || p_partkey AS content FROM part),
 keys AS (SELECT doc, 'id' AS kind, id AS key, content, ord FROM p UNION ALL SELECT doc, 'section', number, arg_max(content, ord), min(ord) FROM p GROUP BY doc, number UNION ALL SELECT doc, 'full', number || title, arg_max(content, ord), min(ord) FROM p GROUP BY doc, number || title UNION ALL SELECT doc, 'heading', title, arg_max(content, ord), min(ord) FROM p GROUP BY doc, title),
 refs AS (SELECT p_brand AS doc, CASE p_size % 7 WHEN 0 THEN '<PRT-' || p_partkey || '>' WHEN 1 THEN '< PRT-' || p_partkey || ' >' WHEN 2 THEN p_size || '.' || p_partkey WHEN 3 THEN p_size || '.' || p_partkey || p_name WHEN 4 THEN '见' || p_size || '.' || p_partkey || p_name WHEN 5 THEN '关于' || p_name ELSE p_size || '.' || p_partkey || '.1 別' END AS ref FROM part)"""


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as items and as sections of brands."""
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), F.concat(F.lit("<PRT-"), "p_partkey", F.lit(">")).alias("item_id"), F.concat("p_size", F.lit("."), "p_partkey").alias("section_number"), F.col("p_name").alias("section_title"), F.concat(F.lit("text"), "p_partkey").alias("content"))
    return base.select("doc", "ord", "item_id", "content"), base.select("doc", "ord", "section_number", "section_title", "content", F.concat("section_number", "section_title").alias("full_key"))


@query(f"WITH {_KEYS} SELECT doc, kind AS key_kind, key, content, ord FROM keys")
def content_keys(spark, sf_dir):
    return relations.content_keys(*_parts(spark, sf_dir)).select("doc", "key_kind", "key", "content", "ord")


_NORM = "replace(regexp_replace({0}, '[ \\t]+', '', 'g'), '、', '')"


@query(f"""WITH {_KEYS}, r AS (SELECT DISTINCT doc, ref, {_NORM.format('ref')} AS n, replace(replace(ref, '< ', '<'), ' >', '>') AS idn, regexp_extract(ref, '^([0-9]+([.][0-9]+)*)', 1) AS num FROM refs), k AS (SELECT *, {_NORM.format('key')} AS kn FROM keys),
 e AS (SELECT r.doc, ref, CASE WHEN kind = 'id' AND key = ref THEN 1 WHEN kind = 'id' THEN 2 WHEN kind = 'section' THEN 3 ELSE 4 END AS tier, key, content, 0 AS size, ord FROM r JOIN k ON k.doc = r.doc AND ((kind = 'id' AND (key = ref OR key = idn)) OR (kind = 'section' AND key = ref) OR (kind = 'full' AND (key = ref OR key = n)))),
 l AS (SELECT r.doc, ref, CASE WHEN kind = 'full' AND (contains(kn, n) OR contains(n, kn)) THEN 5 WHEN kind = 'heading' AND (contains(kn, n) OR contains(n, kn)) THEN 6 WHEN kind = 'section' AND num <> '' AND (starts_with(key, num) OR starts_with(num, key)) THEN 7 END AS tier, key, content, CASE WHEN kind = 'section' THEN CASE WHEN key = num THEN -1000000 ELSE -length(key) END ELSE 0 END AS size, ord FROM r JOIN k ON k.doc = r.doc AND kind <> 'id' WHERE (r.doc, ref) NOT IN (SELECT doc, ref FROM e))
SELECT doc, ref, tier, key, content FROM (SELECT *, row_number() OVER (PARTITION BY doc, ref ORDER BY tier, size, ord, key) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM l WHERE tier IS NOT NULL)) WHERE n = 1""")
def tiered_resolve(spark, sf_dir):
    """References of seven forms, one for each tier but the last, which takes what is left."""
    number = F.concat("p_size", F.lit("."), "p_partkey")
    forms = F.array(F.concat(F.lit("<PRT-"), "p_partkey", F.lit(">")), F.concat(F.lit("< PRT-"), "p_partkey", F.lit(" >")), number, F.concat(number, "p_name"), F.concat(F.lit("见"), number, "p_name"), F.concat(F.lit("关于"), "p_name"), F.concat(number, F.lit(".1 別")))
    refs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.get(forms, F.col("p_size") % 7).alias("ref"))
    return relations.resolved(refs, relations.content_keys(*_parts(spark, sf_dir))).select("doc", "ref", "tier", "key", "content")


@query("""WITH ent AS (SELECT p_brand AS doc, p_partkey AS ord FROM part),
 r AS (SELECT CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '文件 ' || p_brand ELSE 'zzz' END AS name, CASE p_size % 2 WHEN 0 THEN '< ' || md5(CAST(p_partkey AS VARCHAR)) || '9>' ELSE '见<' || md5(CAST(p_partkey AS VARCHAR)) || '9>的要求' END AS ref, p_partkey, p_size % 2 AS t FROM part)
SELECT name, ref, e.doc, e.ord, CAST(CASE t WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS tier FROM r JOIN ent e ON e.ord = p_partkey""")
def forward_references(spark, sf_dir):
    """References to parts by exact and by longer texts, in documents named exactly, in part, or wrongly."""
    part = table(spark, sf_dir, "part").withColumn("id", F.concat(F.md5(F.col("p_partkey").cast("string").cast("binary")), F.lit("9>")))
    none = F.lit("")
    ent = part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), F.concat(F.lit("<"), "id").alias("key"), F.concat(F.lit("<"), "id").alias("item_id"), none.alias("section_number"), none.alias("section_title"))
    docs = part.select(F.col("p_brand").alias("doc")).distinct().withColumn("doc_ord", F.col("doc"))
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("文件 "), "p_brand")).otherwise("zzz")
    ref = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("< "), "id")).otherwise(F.concat(F.lit("见<"), "id", F.lit("的要求")))
    return forward.matched_entries(part.select(name.alias("name"), ref.alias("ref")), forward.entry_keys(ent), docs)


# ---- scores and decisions ---------------------------------------------------------------------

_O = DiscoveryOptions()


@query("""WITH e AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS s, abs(CAST(embedding[2] AS DOUBLE)) AS c, abs(CAST(embedding[3] AS DOUBLE)) AS i, abs(CAST(embedding[4] AS DOUBLE)) AS t, abs(CAST(embedding[5] AS DOUBLE)) / 4 AS a FROM embeddings)
SELECT vec_id, round(least(1, (0.5 * s + 0.2 * c + 0.2 * i + 0.1 * t) * CASE WHEN vec_id % 3 = 0 THEN 0.85 ELSE 1 END + CASE WHEN vec_id % 2 = 0 AND least(1, a / 0.1) >= 0.3 THEN 0.5 * least(1, a / 0.1) ELSE 0 END), 6) AS score FROM e""")
def fused_score(spark, sf_dir):
    x = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    base = V.fused(x(0), x(1), x(2), x(3), F.when(F.col("vec_id") % 3 == 0, 0.85).otherwise(1.0), _O)
    return table(spark, sf_dir, "embeddings").select("vec_id", six(V.boosted(base, x(4) / 4, F.col("vec_id") % 2 == 0, _O)).alias("score"))


@query("""WITH c AS (SELECT l_orderkey AS d, l_linenumber AS u, l_discount * 10 AS score, CASE WHEN l_returnflag = 'N' THEN 'section' ELSE 'item' END AS kind FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)),
 r AS (SELECT *, row_number() OVER w AS r, first_value(u) OVER w AS top, first_value(score) OVER w AS ts, first_value(kind) OVER w AS tk FROM c WINDOW w AS (PARTITION BY d ORDER BY score DESC, u)),
 m AS (SELECT *, tk = 'section' AND u <> top AND (u + top) % 2 = 1 AND score >= ts - 0.05 AS close FROM r), n AS (SELECT *, CASE WHEN close AND sum(CAST(close AS INTEGER)) OVER (PARTITION BY d) = 1 THEN 0 ELSE r END AS k FROM m)
SELECT d, u, CAST(row_number() OVER (PARTITION BY d ORDER BY k, r) AS INTEGER) AS rank FROM n""")
def folded_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("u")).agg(F.max("l_discount").alias("x"), F.min("l_returnflag").alias("f"))
    scored = rows.select("d", "u", (F.col("x") * 10).alias("score"), F.when(F.col("f") == "N", "section").otherwise("item").alias("kind"))
    numbers = scored.select("u").distinct()
    graph = numbers.select(F.col("u").alias("section")).join(numbers.select(F.col("u").alias("item")), (F.col("section") + F.col("item")) % 2 == 1)
    return discovery.folded(scored, graph, _O).select("d", "u", "rank")


@query("""SELECT o_custkey AS doc, o_orderkey AS d, CASE WHEN l.u IS NULL THEN '' ELSE 'u' || l.u END AS upstream_ref, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, coalesce(score, 0) AS candidate_score,
 CASE WHEN l.u IS NOT NULL THEN printf('score=%.2f', score) ELSE 'UNTRACED | 参考候选: U:u' || o_orderkey % 7 || '(0.25)' END AS evidence FROM orders LEFT JOIN (SELECT l_orderkey AS d, l_linenumber AS u, CAST(max(l_quantity) AS DOUBLE) / 63 AS score FROM lineitem GROUP BY 1, 2) l ON l.d = o_orderkey AND o_orderstatus <> 'O'""")
def matrix_rows(spark, sf_dir):
    """Orders as decisions with their line items as relations; open ones are untraced and have a reference candidate."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("u")).agg((F.max("l_quantity") / 63).alias("score"))
    rel = items.groupBy("d").agg(F.sort_array(F.collect_list(F.struct(F.col("u").cast("int").alias("rank"), F.col("u").cast("long").alias("u"), "score"))).alias("rels"))
    joined = orders.select(F.col("o_orderkey").alias("d"), "o_orderstatus").join(rel, "d", "left")
    none = F.array().cast("array<struct<rank:int,u:bigint,score:double>>")
    open_ = (F.col("o_orderstatus") == "O") | F.col("rels").isNull()
    best = F.array(F.struct(F.lit(1).alias("rank"), (F.col("d") % 7).alias("u"), F.lit(0.25).alias("score")))
    decisions = joined.select("d", F.when(open_, "untraced").otherwise("traced").alias("status"), F.lit(False).alias("ambiguous"), F.when(open_, none).otherwise(F.col("rels")).alias("relations"), best.cast("array<struct<rank:int,u:bigint,score:double>>").alias("references"))
    down = orders.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("key"), F.lit("").alias("content"), F.col("o_orderkey").alias("ord"))
    up = spark.range(0, 8).select(F.col("id").alias("uid"), F.lit("U").alias("doc"), F.concat(F.lit("u"), "id").alias("key"), F.lit("").alias("content"), F.lit("item").alias("kind"))
    return matrix.rows_of_decisions(decisions, down, up).select(F.col("downstream_doc").alias("doc"), "d", "upstream_ref", long("seq").alias("seq"), "candidate_score", "evidence")


@query("""SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'BLACK' END AS overall FROM orders GROUP BY o_custkey""")
def overall_class(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "GREEN").when(F.col("o_orderstatus") == "P", "BLUE").otherwise("BLACK").alias("category"))
    return matrix.overall(rows, ["o_custkey"])


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS added, count(*) FILTER (WHERE o_orderstatus = 'O') AS suspicious, count(*) FILTER (WHERE o_orderstatus = 'P') AS agreed, count(*) FILTER (WHERE o_totalprice > 100000) AS ambiguous FROM orders""")
def outcome_counts(spark, sf_dir):
    note = F.when(F.col("o_orderstatus") == "F", "[added] x").when(F.col("o_orderstatus") == "O", "a [suspicious]").otherwise("发现层一致(0.50)")
    return matrix.outcome_counts(table(spark, sf_dir, "orders").select(note.alias("evidence"), (F.col("o_totalprice") > 100000).alias("ambiguous")))


@query("""SELECT conv_id, pos, level FROM (SELECT conv_id, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS level, length(role) AS n, sum(length(role)) OVER (PARTITION BY conv_id ORDER BY turn) - length(role) AS start FROM conversations), range(0, 20) r(i), LATERAL (SELECT start + i AS pos) WHERE i < n""")
def character_classes(spark, sf_dir):
    run = F.struct(F.col("role").alias("text"), F.when(F.col("role") == "user", "GREEN").when(F.col("role") == "assistant", "BLUE").otherwise("BLACK").alias("category"))
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", run.alias("r")))), lambda p: p["r"]).alias("runs"))
    return matrix.character_categories(runs, ["conv_id"]).select("conv_id", long("pos").alias("pos"), "level")


@query(f"""WITH s AS (SELECT item_id, text, {NORMAL('text')} AS n FROM benchmark), d AS (SELECT doc_id, {NORMAL('text')} AS n FROM documents)
SELECT doc_id, item_id, CAST(contains(d.n, s.n) AS DOUBLE) AS anchor FROM d, s WHERE contains(d.n, s.n) AND length(s.n) >= 3 AND NOT contains(s.text, chr(10))""")
def anchor_hits(spark, sf_dir):
    """Passages of one line that documents hold as a whole: their anchor, which is all of the passage, counts in full."""
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").filter(~F.col("text").contains("\n"))
    side = lambda df, key: discovery.profiled(df.select(F.col(key).alias("uid"), F.lit("").alias("key"), F.col("text").alias("content")), latin=True)
    found = discovery.found_anchors(side(docs, "doc_id"), side(passages, "item_id"))
    return found.filter("anchor = 1").select(F.col("d").alias("doc_id"), F.col("u").alias("item_id"), "anchor")

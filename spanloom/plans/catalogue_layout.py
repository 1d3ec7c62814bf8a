"""Queries of the layout, review and rendering operators over boxes, tasks and runs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import adjudicate, experiments, layout, relations
from spanloom.plans.catalogue import _UNITS, _statistics, _units
from spanloom.plans.registry import long, query, six
from spanloom.sources import writers
from spanloom.sources.readers import table

# ---- layout -----------------------------------------------------------------------------------

_PARTS = "p AS (SELECT p_partkey AS block, p_size % 5 AS page, p_brand AS doc, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 700 AS DOUBLE) AS y0, p_size AS w, p_name AS text, p_type FROM part)"


def _blocks(spark, sf_dir) -> DataFrame:
    """Parts as blocks of brands' pages: as wide and high as their size."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("block"), (F.col("p_size") % 5).cast("long").alias("page"), F.col("p_brand").alias("doc"), (k * 37 % 500).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0"), F.col("p_size").cast("double").alias("w"), F.col("p_name").alias("text"), "p_type")
    return rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("w"), "paint_order": F.col("block")})


@query(f"""WITH {_PARTS}, o AS (SELECT *, lag(y0 + w) OVER v AS y, lag(x0) OVER v AS x, lag(10 + w % 3) OVER v AS s FROM p WINDOW v AS (PARTITION BY doc, page ORDER BY y0, x0, block)),
 n AS (SELECT *, sum(CASE WHEN y IS NULL OR y0 - y > 1.6 * 1.2 * (10 + w % 3) - (10 + w % 3) OR abs(x0 - x) >= 32 OR abs(10 + w % 3 - s) > 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, block) AS paragraph FROM o)
SELECT doc, page, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, chr(10) ORDER BY y0, x0, text) AS text, min(x0) AS x0, max(y0 + w) AS y1 FROM n GROUP BY doc, page, paragraph""")
def paragraph_cluster(spark, sf_dir):
    lines = _blocks(spark, sf_dir).withColumns({"font_size": 10 + F.col("w") % 3, "bold": F.lit(False), "font_name": F.lit("f")})
    return layout.paragraphs(lines).select("doc", "page", long("paragraph").alias("paragraph"), "text", "x0", "y1")


@query(f"""WITH {_PARTS} SELECT doc, max(y0 + w) AS height, max(x0 + w) AS width FROM p GROUP BY doc""")
def page_extent(spark, sf_dir):
    lines = _blocks(spark, sf_dir).withColumns({"font_size": F.col("w"), "font_name": F.lit("f")})
    return layout.font_statistics(lines).select("doc", "height", "width")


@query(f"""WITH {_PARTS} SELECT doc, block, CAST(least(dense_rank() OVER (PARTITION BY doc ORDER BY w DESC, p_type LIKE 'E%' DESC), 6) AS INTEGER) AS level FROM p""")
def heading_ranks(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumns({"font_size": F.col("w"), "bold": F.col("p_type").startswith("E")})
    return layout.heading_levels(rows).select("doc", "block", "level")


@query(f"""WITH {_PARTS} SELECT doc, p_type AS font_name, CAST(w AS DOUBLE) AS font_size, count(*) AS times FROM p GROUP BY ALL""")
def font_signatures(spark, sf_dir):
    lines = _blocks(spark, sf_dir).withColumns({"font_name": F.col("p_type"), "font_size": F.col("w"), "bold": F.lit(False)})
    return layout.font_signatures(lines).select("doc", "font_name", "font_size", "times")


@query("""WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS text FROM orders)
SELECT doc, CAST(i // 2 AS INTEGER) AS r, CAST(c AS INTEGER) AS c, text, CASE WHEN wide THEN 2 ELSE 1 END AS colspan FROM (SELECT *, i = n - 1 AND i % 2 = 0 AND n > 1 AS wide FROM o), (VALUES (0), (1)) v(c) WHERE wide OR i % 2 = c""")
def ruled_tables(spark, sf_dir):
    """Orders of a customer two by two as ruled cells; a last one without a neighbour is twice as wide."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), i.alias("i"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), F.col("o_orderpriority").alias("text"))
    x0, y0 = (F.col("i") % 2) * 100.0, F.floor(F.col("i") / 2) * 20.0
    wide = F.when((F.col("i") % 2 == 0) & (F.col("i") == F.col("n") - 1), 200.0).otherwise(100.0)
    cells = rows.select("doc", F.lit(0).alias("page"), F.lit(1).alias("table"), x0.alias("x0"), y0.alias("y0"), (x0 + wide).alias("x1"), (y0 + 20.0).alias("y1"), "text", F.lit("s").alias("style"))
    return layout.ruled_tables(cells).select("doc", "r", "c", "text", "colspan")


@query(f"""WITH {_PARTS}, f AS (SELECT *, p_type LIKE 'S%' AS image FROM p), c AS (SELECT a.doc, a.page, a.block AS caption, b.block AS image, sqrt((a.x0 + a.w / 2 - b.x0 - b.w / 2) ** 2 + (a.y0 + a.w / 2 - b.y0 - b.w / 2) ** 2) AS far, greatest(a.y0 - b.y0 - b.w, b.y0 - a.y0 - a.w, 0) AS gap FROM f a JOIN f b ON a.doc = b.doc AND a.page = b.page AND NOT a.image AND b.image)
SELECT doc, page, caption, image FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, caption ORDER BY far, image) AS n FROM c WHERE gap <= 60) WHERE n = 1""")
def caption_pairs(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    is_image = F.col("p_type").startswith("S")
    return layout.captions_of(rows.filter(is_image).withColumnRenamed("block", "image"), rows.filter(~is_image))


_OVERLAP = "greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.w, b.y0 + b.w) - greatest(a.y0, b.y0), 0)"


@query(f"""WITH {_PARTS} SELECT DISTINCT a.doc, a.page, a.block FROM p a JOIN p b ON a.doc = b.doc AND a.page = b.page AND a.p_type NOT LIKE 'S%' AND b.p_type LIKE 'S%' WHERE {_OVERLAP} > 0.3 * least(a.w * a.w, b.w * b.w)""")
def table_overlaps(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    return layout.overlapping_tables(rows.filter(~F.col("p_type").startswith("S")), rows.filter(F.col("p_type").startswith("S")))


@query(f"""WITH {_PARTS} SELECT a.doc, a.page, a.block FROM p a WHERE a.p_type NOT LIKE 'S%' AND NOT EXISTS (SELECT 1 FROM p b WHERE a.doc = b.doc AND a.page = b.page AND b.p_type LIKE 'S%' AND {_OVERLAP} > 0.5 * a.w * a.w)""")
def outside_regions(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    return layout.outside_regions(rows.filter(~F.col("p_type").startswith("S")), rows.filter(F.col("p_type").startswith("S"))).select("doc", "page", "block")


@query(f"""WITH {_PARTS} SELECT a.doc, a.page, a.block, min(b.block) AS attached_to FROM p a LEFT JOIN p b ON a.doc = b.doc AND a.page = b.page AND b.block > a.block AND b.p_type NOT LIKE 'S%' WHERE a.p_type LIKE 'S%' GROUP BY ALL""")
def attached_images(spark, sf_dir):
    return layout.attached_images(_blocks(spark, sf_dir).withColumn("kind", F.when(F.col("p_type").startswith("S"), "image").otherwise("text")))


@query(f"""WITH {_PARTS}, r AS (SELECT *, round_even(y0 / 100, 0) AS r, lag(x0 + w) OVER (PARTITION BY doc, page, round_even(y0 / 100, 0) ORDER BY x0, x0 + w, text) AS b FROM p), f AS (SELECT *, sum(CASE WHEN b IS NULL OR x0 - b > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, r ORDER BY x0, x0 + w, text) AS field FROM r)
SELECT doc, page, CAST(r AS BIGINT) AS "row", list(text ORDER BY field) AS cells FROM (SELECT doc, page, r, field, string_agg(text, ' ' ORDER BY x0, text) AS text FROM f GROUP BY doc, page, r, field) GROUP BY doc, page, r""")
def stream_cells(spark, sf_dir):
    return layout.stream_rows(_blocks(spark, sf_dir), 100.0, 30.0).select("doc", "page", long("row").alias("row"), "cells")


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderstatus, o_orderpriority FROM orders)
SELECT doc, ['S' || any_value(o_orderstatus) FILTER (WHERE r = 0), any_value(o_orderpriority) FILTER (WHERE r = 0)] AS headers, list(['S' || o_orderstatus, o_orderpriority] ORDER BY r) FILTER (WHERE r > 0) AS rows FROM c GROUP BY doc HAVING count(*) >= 2""")
def flat_tables(spark, sf_dir):
    """Orders as rows of structured tables with untidy cells."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(0).alias("page"), F.lit(1).alias("table"), r.alias("r"), "o_orderstatus", "o_orderpriority")
    cells = rows.select("doc", "page", "table", "r", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.concat(F.lit(" S"), "o_orderstatus", F.lit("\n \n")).alias("text")), F.struct(F.lit(1).alias("c"), F.col("o_orderpriority").alias("text")))).alias("x")).select("doc", "page", "table", "r", "x.*")
    return layout.flat_tables(cells).select("doc", "headers", "rows")


@query("""SELECT user_id AS doc, avg(CAST(value >= 60 AS INTEGER)) >= 0.7 AS text_layer FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY user_id) // 10) AS step FROM events) WHERE i % step = 0 AND i / step < 10 GROUP BY user_id""")
def text_layers(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), F.repeat(F.lit("x"), F.when(F.col("value") >= 60, 60).otherwise(59)).alias("text"))
    return layout.has_text_layer(pages)


# ---- review -----------------------------------------------------------------------------------


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'suspicious' WHEN bool_and(o_orderpriority LIKE '1%') THEN 'untraced' WHEN bool_or(o_orderstatus = 'F') THEN 'added' ELSE 'ambiguous' END AS task_type FROM orders GROUP BY o_custkey
HAVING (bool_or(o_orderstatus IN ('P', 'F')) OR bool_and(o_orderpriority LIKE '1%') OR bool_or(o_totalprice > 200000)) AND max(o_orderkey % 4) > 0""")
def review_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "[suspicious] x").when(F.col("o_orderstatus") == "F", "[added] y").otherwise("").alias("evidence"), F.when(F.col("o_orderpriority").startswith("1"), "").otherwise("r").alias("upstream_ref"), (F.col("o_totalprice") > 200000).alias("ambiguous"), (F.col("o_orderkey") % 4).alias("n_candidates"))
    return adjudicate.eligible(rows, ["o_custkey"])


@query("""SELECT p_partkey, sha256('model' || chr(10) || 'system' || chr(10) || '下游内容:' || chr(10) || p_name || chr(10) || chr(10) || '候选上游:' || chr(10) || '[A] ' || p_brand || ' ' || p_size || chr(10) || p_type || chr(10) || chr(10) || '[B] ' || p_brand || ' 0' || chr(10) || 'b' || chr(10) || chr(10) || '请判断') AS cache_key FROM part""")
def review_prompts(spark, sf_dir):
    one = lambda label, key, content: F.struct(F.lit(label).alias("label"), F.col("p_brand").alias("doc"), key.alias("key"), content.alias("content"))
    asked = adjudicate.prompt(F.col("p_name"), F.array(one("A", F.col("p_size").cast("string"), F.col("p_type")), one("B", F.lit("0"), F.lit("b"))), F.lit("请判断"))
    return table(spark, sf_dir, "part").select("p_partkey", adjudicate.cache_key(F.lit("model"), F.lit("system"), asked).alias("cache_key"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'B' WHEN 1 THEN '无' WHEN 2 THEN 'A' WHEN 3 THEN '都无' ELSE '无' END AS verdict, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE round(p_size / 100, 6) END AS confidence FROM part""")
def review_answers(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, (" B ", "无", "应为 A，不是 B", "都无", "不知道"))), F.col("p_size") % 5)
    answer = F.concat(F.lit("好的 ```{\"verdict\": \""), said, F.lit("\", \"confidence\": "), F.when(F.col("p_size") % 2 == 0, "7.5").otherwise((F.col("p_size") / 100).cast("string")), F.lit("}``` 完"))
    told = table(spark, sf_dir, "part").select("p_partkey", adjudicate.parsed_answer(answer).alias("a"))
    return told.select("p_partkey", adjudicate.normal_verdict(F.col("a.verdict"), F.array(F.lit("A"), F.lit("B"))).alias("verdict"), six(adjudicate.bounded_confidence(F.col("a.confidence"))).alias("confidence"))


@query("""SELECT p_partkey, '选' || p_brand || '而非' || p_type || '与' || p_type || '1' AS text FROM part""")
def label_names(spark, sf_dir):
    names = F.array(F.struct(F.lit("A").alias("label"), F.col("p_type").alias("name")), F.struct(F.lit("AA").alias("label"), F.col("p_brand").alias("name")))
    return table(spark, sf_dir, "part").select("p_partkey", adjudicate.with_names(F.lit("选AA而非A与A1"), names).alias("text"))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 || ': A (0.90) ' || repeat('r', least(200, CAST(o_custkey AS INTEGER))) END AS ai_opinion, o_totalprice > 100000 AND o_custkey % 3 <> 1 AS ambiguous FROM orders""")
def disposed_rows(spark, sf_dir):
    """Verdicts on two thirds of the customers, of which a half confirm."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 100000).alias("ambiguous"))
    third = F.col("o_custkey") % 3
    verdicts = rows.select("o_custkey").distinct().select("o_custkey", F.when(third == 0, "ignore").when(third == 1, "confirm").otherwise("advise").alias("outcome"), F.lit("A").alias("verdict"), F.lit(0.9).alias("confidence"), F.repeat(F.lit("r"), F.col("o_custkey").cast("int")).alias("reasoning"))
    done = adjudicate.disposed(rows, verdicts, ["o_custkey"])
    return done.select("o_custkey", "o_orderkey", F.regexp_replace(F.regexp_replace("ai_opinion", "^confirm", "1"), "^advise", "2").alias("ai_opinion"), "ambiguous")


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'confirm' WHEN 'P' THEN 'none' ELSE 'advise' END AS outcome, count(*) AS verdicts FROM orders GROUP BY 1""")
def answer_counts(spark, sf_dir):
    return adjudicate.answer_counts(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "confirm").when(F.col("o_orderstatus") == "P", "none").otherwise("advise").alias("outcome")))


# ---- rendering --------------------------------------------------------------------------------


@query("""SELECT p_partkey, '<span style="color:#00B050">&lt;' || p_name || '&gt;</span><span style="color:#0070C0">' || p_brand || '<br></span>' || CASE WHEN length(p_name) + 2 + length(p_brand) + 1 <= 20 THEN '<span style="color:#000000">x</span>' ELSE '' END AS html FROM part""")
def html_cells(spark, sf_dir):
    run = lambda text, category: F.struct(text.alias("text"), F.lit(category).alias("category"))
    runs = F.array(run(F.concat(F.lit("<"), "p_name", F.lit(">")), "GREEN"), run(F.concat("p_brand", F.lit("\n")), "BLUE"), run(F.lit("x"), "BLACK"))
    return table(spark, sf_dir, "part").select("p_partkey", writers.html_runs(runs, 20).alias("html"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN 'R1' ELSE p_name END AS ref, CASE WHEN i = 1 AND p_size % 2 = 0 THEN p_type ELSE p_brand END AS doc FROM part, range(0, 2) r(i)""")
def split_references(spark, sf_dir):
    ref = F.concat(F.lit(" R1\n\n"), "p_name", F.lit(" "))
    doc = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("\n"), "p_type")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(relations.split_cells(ref, doc)).alias("i", "c")).select("p_partkey", "i", "c.ref", "c.doc")


# ---- experimental channels --------------------------------------------------------------------


@query(f"""WITH {_UNITS}, rare AS (SELECT side, id, token, ln(n / df) + 1 AS w FROM one JOIN stats USING (token) WHERE df <= greatest(2, floor(n / 10))), sums AS (SELECT side, id, sum(w) AS total FROM rare GROUP BY side, id),
 hit AS (SELECT d.id AS d, u.id AS u, sum(w.w) AS w FROM one d JOIN one u USING (token) JOIN (SELECT DISTINCT token, w FROM rare) w USING (token) WHERE d.side = 'd' AND u.side = 'u' GROUP BY d.id, u.id), pr AS (SELECT d, u, w / a.total AS p, w / b.total AS r FROM hit JOIN sums a ON a.side = 'd' AND a.id = d JOIN sums b ON b.side = 'u' AND b.id = u)
SELECT d AS doc_id, u AS item_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(5 * p * r / (4 * p + r), 6) AS f2, round(greatest(p, r), 6) AS best FROM pr""")
def rare_word_modes(spark, sf_dir):
    down, up = _units(spark, sf_dir)
    found = experiments.rare_hits(down, up, _statistics(down, up))
    return found.select((F.col("d") / 2).cast("long").alias("doc_id"), F.floor(F.col("u") / 2).alias("item_id"), *(six(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "f2", "best")))


@query(f"""WITH {_UNITS}, rare AS (SELECT side, id, token FROM one JOIN stats USING (token) WHERE df <= greatest(2, floor(n / 10))), c AS (SELECT side, id, count(*) AS k FROM rare GROUP BY side, id), pairs AS (SELECT d.id AS d, u.id AS u, count(*) AS n FROM rare d JOIN rare u USING (token) WHERE d.side = 'd' AND u.side = 'u' GROUP BY d.id, u.id)
SELECT d AS doc_id, u AS item_id, round(n / (a.k + b.k - n), 6) AS labels FROM pairs JOIN c a ON a.side = 'd' AND a.id = d JOIN c b ON b.side = 'u' AND b.id = u""")
def rare_label_jaccard(spark, sf_dir):
    down, up = _units(spark, sf_dir)
    found = experiments.rare_labels(down, up, _statistics(down, up), "^.")
    return found.select((F.col("d") / 2).cast("long").alias("doc_id"), F.floor(F.col("u") / 2).alias("item_id"), six(F.col("labels")).alias("labels"))

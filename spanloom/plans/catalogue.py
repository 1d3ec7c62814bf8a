"""Queries over the driver's tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vector as V
from spanloom.operators import adjudicate, compare, discovery, layout, matrix, relations, units, verify
from spanloom.options import DiscoveryOptions
from spanloom.plans.registry import NORMAL, ORACLE_SQL, QUERIES, STRIPPED, long, query, six  # noqa: F401
from spanloom.session import cut
from spanloom.sources.readers import table

#: Weights and thresholds for Latin texts without an encoder.
LATIN = DiscoveryOptions(w_sem=0.0, w_contain=0.5, w_idf=0.3, w_tfidf=0.2, theta=0.2, recall_k=5, coarse_k=10)


# ---- text expressions -------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(length(t) AS BIGINT) AS norm_length, md5(t) AS norm_md5 FROM (SELECT doc_id, {NORMAL('text')} AS t FROM documents)")
def norm_text(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("t"))
    return t.select("doc_id", long(F.length("t")).alias("norm_length"), F.md5(F.col("t").cast("binary")).alias("norm_md5"))


@query("""SELECT o_custkey AS doc, CAST(count(*) AS INTEGER) AS n_ids, CASE WHEN count(*) >= 3 THEN 'id_based' ELSE 'chapter_based' END AS doc_type FROM orders GROUP BY o_custkey""")
def doc_type_flags(spark, sf_dir):
    """Customers as documents that name each order twice, with and without white space in the brackets."""
    named = F.concat(F.lit("见 < ORD-"), "o_orderkey", F.lit("> 与 <ORD-"), "o_orderkey", F.lit(">。"))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.collect_list(named), "\n").alias("text"))
    return units.document_type(docs)


@query(r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS sentence_chars
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 4) AS s FROM documents)""")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"), 4, r"[.;!?\n]+")
    docs = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return docs.select("doc_id", long(F.size("s")).alias("n_sentences"), long(F.aggregate("s", F.lit(0), lambda t, x: t + F.length(x))).alias("sentence_chars"))


def _adjacent(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(order).alias("a"), F.col("text").alias("b"))
    # a set number of partitions, since much work on small texts would else be put into one
    return rows.filter(F.col("a").isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")


def _normal_pairs(spark, sf_dir) -> DataFrame:
    """Both texts in normal form, as columns, so that nothing that reads them more than once makes it anew."""
    return _adjacent(spark, sf_dir).select("conv_id", "turn", T.normalised(F.col("a")).alias("a"), T.normalised(F.col("b")).alias("b"))


_ADJACENT = "(SELECT * FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations) WHERE a IS NOT NULL)"
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substring({0}, i, 2)))"
_NORMAL_PAIRS = f"(SELECT conv_id, turn, {NORMAL('a')} AS a, {NORMAL('b')} AS b FROM {_ADJACENT})"
_LIKENESS = "SELECT conv_id, turn, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS likeness FROM"


@query(f"{_LIKENESS} (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM {_NORMAL_PAIRS})")
def char_set_jaccard(spark, sf_dir):
    return _normal_pairs(spark, sf_dir).select("conv_id", "turn", six(T.normal_char_set_jaccard(F.col("a"), F.col("b"))).alias("likeness"))


@query(f"{_LIKENESS} (SELECT *, {_BIGRAMS.format('a')} AS x, {_BIGRAMS.format('b')} AS y FROM {_NORMAL_PAIRS})")
def bigram_jaccard(spark, sf_dir):
    return _normal_pairs(spark, sf_dir).select("conv_id", "turn", six(T.normal_bigram_jaccard(F.col("a"), F.col("b"))).alias("likeness"))


@query(f"""SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(CASE WHEN la <= lb THEN x ELSE y END), 6) AS contained
FROM (SELECT conv_id, turn, length(a) AS la, length(b) AS lb, {_BIGRAMS.format('a')} AS x, {_BIGRAMS.format('b')} AS y FROM {_ADJACENT})""")
def bigram_containment(spark, sf_dir):
    return _adjacent(spark, sf_dir).select("conv_id", "turn", six(T.containment(F.col("a"), F.col("b"))).alias("contained"))


@query(r"""SELECT part.p_partkey, lower(regexp_extract(b, '([A-Za-z]+)([0-9]+)$', 1)) || CAST(CAST(regexp_extract(b, '([A-Za-z]+)([0-9]+)$', 2) AS BIGINT) AS VARCHAR) AS core
FROM (SELECT p_partkey, replace(replace(p_brand, '#', ''), ' ', '') AS b FROM part) part""")
def id_core(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.id_core(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("core"))


@query(r"""SELECT page_id, substring(CASE WHEN c = '' THEN 'Sheet' ELSE c END, 1, 31) AS sheet
FROM (SELECT page_id, substring(trim(regexp_replace(url, '[:\\/?*\[\]]', '', 'g')), 1, 31) AS c FROM pages)""")
def sheet_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sheet_name(F.col("url")).alias("sheet"))


@query(r"""SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda l: greatest(1, CAST(ceil((length(l) + length(regexp_replace(l, '[\x00-\x7F]', '', 'g'))) / 48) AS BIGINT)))) AS BIGINT) AS visible_lines FROM documents""")
def visible_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", long(T.visible_lines(F.col("text"), 50)).alias("visible_lines"))


@query(r"""SELECT doc_id, greatest(n, CAST(floor(n * CAST(1.15 AS DOUBLE)) AS BIGINT) + CASE WHEN n > 3 THEN 1 ELSE 0 END) AS generous_lines FROM (SELECT doc_id, CAST(list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: greatest(1, CAST(ceil((length(l) + length(regexp_replace(l, '[\x00-\x7F]', '', 'g'))) / 53) AS BIGINT)))) AS BIGINT) AS n FROM documents)""")
def generous_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", long(T.generous_lines(F.col("text"), 55)).alias("generous_lines"))


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS escaped_md5 FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 900 THEN substring(text, 1, 900) || '…(截断, 原文' || length(text) || '字)' ELSE text END) AS clipped_md5 FROM documents""")
def prompt_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clipped(F.col("text"), 900).cast("binary")).alias("clipped_md5"))


@query(r"""SELECT event_id, json_extract_string(o, '$.k') AS k, j IS NOT NULL AS is_object
FROM (SELECT event_id, nullif(regexp_extract('reply: ' || props || ' end', '(?s)\{.*\}', 0), '') AS o, nullif(regexp_extract(props, '(?s)\{.*\}', 0), '') AS j FROM events)""")
def json_tolerant(spark, sf_dir):
    raw = F.concat(F.lit("reply: "), "props", F.lit(" end"))
    o = T.outermost_json(raw)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(o, "$.k").alias("k"), T.outermost_json(F.col("props")).isNotNull().alias("is_object"))


@query("""WITH c AS (SELECT p_partkey, string_split(p_type, ' ') AS w, p_size FROM part)
SELECT a.p_partkey, b.p_partkey AS other, len(list_intersect(a.w, b.w)) = 0 AS mismatch FROM c a JOIN c b ON b.p_partkey = a.p_partkey + 1""")
def class_mismatch(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("w"))
    other = part.select(F.col("p_partkey").alias("other"), (F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v"))
    return part.join(other, "p_partkey").select("p_partkey", "other", T.class_mismatch(F.col("w"), F.col("v")).alias("mismatch"))


# ---- tokens, channels, discovery --------------------------------------------------------------

_UNITS = r"""tokens AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id, length(text) AS chars, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{4,}') AS t FROM documents
  UNION ALL SELECT 'u', item_id, length(text), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{4,}') FROM benchmark
), flat AS MATERIALIZED (SELECT side, id, unnest(t) AS token FROM tokens
), one AS MATERIALIZED (SELECT DISTINCT side, id, token FROM flat
), total AS (SELECT count(*) AS n FROM tokens
), stats AS MATERIALIZED (SELECT token, count(*) AS df, any_value(n) AS n FROM one, total GROUP BY token)"""


def _profiled_units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents against benchmark passages, with all that :func:`discovery.profiled` adds; downstream ids are even, upstream ids odd."""
    profile = lambda df, uid, kind: discovery.profiled(df.select(uid.alias("uid"), F.lit("x").alias("doc"), F.lit(kind).alias("kind"), F.lit("").alias("key"), F.col("text").alias("content")), latin=True)
    return profile(table(spark, sf_dir, "documents"), F.col("doc_id") * 2, "item"), profile(table(spark, sf_dir, "benchmark"), F.col("item_id") * 2 + 1, "item")


def _units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tokens and grams alone of the same units."""
    return tuple(cut(side.select("uid", "tokens", "grams")) for side in _profiled_units(spark, sf_dir))


def _statistics(down: DataFrame, up: DataFrame) -> DataFrame:
    return discovery.token_statistics(down.select("uid", "tokens").unionByName(up.select("uid", "tokens")))


@query(f"WITH {_UNITS} SELECT token, df, df <= greatest(2, floor(n / 10)) AS rare, round(ln(n / df) + 1, 6) AS rare_weight FROM stats")
def token_df(spark, sf_dir):
    return _statistics(*_units(spark, sf_dir)).select("token", "df", "rare", six(F.col("rare_weight")).alias("rare_weight"))


@query(f"""WITH {_UNITS}, raw AS (SELECT side, id, token, (1 + ln(count(*))) * any_value(ln((n + 1) / (df + 1)) + 1) AS x FROM flat JOIN stats USING (token) GROUP BY side, id, token)
SELECT side || id AS unit, count(*) AS terms, round(max(x) / sqrt(sum(x * x)), 6) AS peak, round(sum(x) / sqrt(sum(x * x)), 6) AS total FROM raw GROUP BY side, id""")
def tfidf_norm(spark, sf_dir):
    down, up = _units(spark, sf_dir)
    rows = discovery.tfidf_rows(down.select("uid", "tokens").unionByName(up.select("uid", "tokens")), _statistics(down, up))
    name = F.concat(F.when(F.col("uid") % 2 == 0, "d").otherwise("u"), F.floor(F.col("uid") / 2).cast("string"))
    return rows.groupBy("uid").agg(F.count("*").alias("terms"), six(F.max("w")).alias("peak"), six(F.sum("w")).alias("total")).select(name.alias("unit"), "terms", "peak", "total")


@query(f"""WITH {_UNITS}, rare AS (SELECT u.id AS u, token, ln(n / df) + 1 AS w FROM one u JOIN stats USING (token) WHERE side = 'u' AND df <= greatest(2, floor(n / 10))),
 all_w AS (SELECT u, sum(w) AS total FROM rare GROUP BY u)
SELECT d.id AS doc_id, u AS item_id, round(sum(w) / any_value(total), 6) AS hit_rate FROM rare JOIN one d USING (token) JOIN all_w USING (u) WHERE d.side = 'd' GROUP BY d.id, u""")
def idf_hit_rate(spark, sf_dir):
    down, up = _units(spark, sf_dir)
    pairs = discovery.rare_hit_pairs(down, up, _statistics(down, up))
    return pairs.select((F.col("d") / 2).cast("long").alias("doc_id"), F.floor(F.col("u") / 2).alias("item_id"), six(F.col("idf")).alias("hit_rate"))


@query(f"""WITH {_UNITS}, w AS (SELECT side, id, token, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS w FROM (SELECT side, id, token, (1 + ln(count(*))) * any_value(ln((n + 1) / (df + 1)) + 1) AS x FROM flat JOIN stats USING (token) GROUP BY side, id, token))
SELECT d.id AS doc_id, u.id AS item_id, round(sum(d.w * u.w), 6) AS cosine FROM w d JOIN w u USING (token) WHERE d.side = 'd' AND u.side = 'u' GROUP BY d.id, u.id""")
def tfidf_cosine(spark, sf_dir):
    down, up = _units(spark, sf_dir)
    rows = lambda part: discovery.tfidf_rows(part, _statistics(down, up))
    pairs = discovery.tfidf_pairs(rows(down), rows(up))
    return pairs.select((F.col("d") / 2).cast("long").alias("doc_id"), F.floor(F.col("u") / 2).alias("item_id"), six(F.col("tfidf")).alias("cosine"))


_W2 = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{2,}}')"


@query(f"""WITH g AS MATERIALIZED (SELECT 's' AS kind, doc_id AS id, list_distinct({_W2.format('text')}) AS g FROM documents WHERE n_chars > 300 UNION ALL SELECT 'i', doc_id, list_distinct({_W2.format('text')}) FROM documents WHERE n_chars <= 300),
 f AS MATERIALIZED (SELECT kind, id, len(g) AS n, unnest(g) AS gram FROM g)
SELECT s.id AS section, i.id AS item FROM f s JOIN f i USING (gram) WHERE s.kind = 's' AND i.kind = 'i' GROUP BY s.id, i.id HAVING count(*) >= 0.7 * any_value(i.n)""")
def containment_graph(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") > 300, "section").otherwise("item")
    return discovery.containment_graph(docs.select(F.col("doc_id").alias("uid"), kind.alias("kind"), F.array_distinct(T.words(F.col("text"))).alias("grams")))


_SCORES = f"""{_UNITS}, w AS MATERIALIZED (SELECT side, id, token, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS w FROM (SELECT side, id, token, (1 + ln(count(*))) * any_value(ln((n + 1) / (df + 1)) + 1) AS x FROM flat JOIN stats USING (token) GROUP BY side, id, token)),
 tf AS (SELECT d.id AS d, u.id AS u, sum(d.w * u.w) AS tfidf FROM w d JOIN w u USING (token) WHERE d.side = 'd' AND u.side = 'u' GROUP BY d.id, u.id),
 rare AS MATERIALIZED (SELECT id AS u, token, ln(n / df) + 1 AS w FROM one JOIN stats USING (token) WHERE side = 'u' AND df <= greatest(2, floor(n / 10))),
 idf AS (SELECT d.id AS d, u, sum(w) / any_value(total) AS idf FROM rare JOIN (SELECT u, sum(w) AS total FROM rare GROUP BY u) USING (u) JOIN one d USING (token) WHERE d.side = 'd' GROUP BY d.id, u),
 grams AS MATERIALIZED (SELECT 'd' AS side, doc_id AS id, length(text) AS chars, list_distinct({_W2.format('text')}) AS g FROM documents UNION ALL SELECT 'u', item_id, length(text), list_distinct({_W2.format('text')}) FROM benchmark),
 fg AS MATERIALIZED (SELECT side, id, len(g) AS n, unnest(g) AS gram FROM grams),
 con AS (SELECT d.id AS d, u.id AS u, count(*) / least(any_value(d.n), any_value(u.n)) AS contain FROM fg d JOIN fg u USING (gram) WHERE d.side = 'd' AND u.side = 'u' GROUP BY d.id, u.id),
 sc AS MATERIALIZED (SELECT d, u, round(0.5 * coalesce(contain, 0) + 0.3 * coalesce(idf, 0) + 0.2 * coalesce(tfidf, 0), 6) AS score FROM con FULL JOIN idf USING (d, u) FULL JOIN tf USING (d, u))"""


def _scores(spark, sf_dir) -> DataFrame:
    """The lexical channels of documents and passages, fused; containment over the smaller set of words."""
    down, up = _units(spark, sf_dir)
    joined = discovery.lexical_pairs(down, up, _statistics(down, up), F.size("grams"))
    score = V.fused(F.lit(0.0), F.col("contain"), F.col("idf"), F.col("tfidf"), F.lit(1.0), LATIN)
    return joined.select((F.col("d") / 2).cast("long").alias("d"), F.floor(F.col("u") / 2).alias("u"), six(F.col("contain")).alias("contain"), six(F.col("idf")).alias("idf"), six(F.col("tfidf")).alias("tfidf"), six(score).alias("score"))


@query(f"""WITH {_SCORES}, r AS (SELECT d, u, row_number() OVER (PARTITION BY d ORDER BY round(contain, 6) DESC, u) AS a, row_number() OVER (PARTITION BY d ORDER BY round(idf, 6) DESC, u) AS b, row_number() OVER (PARTITION BY d ORDER BY round(tfidf, 6) DESC, u) AS c
 FROM (SELECT d, u, coalesce(contain, 0) AS contain, coalesce(idf, 0) AS idf, coalesce(tfidf, 0) AS tfidf FROM con FULL JOIN idf USING (d, u) FULL JOIN tf USING (d, u)))
SELECT d AS doc_id, u AS item_id FROM r WHERE a <= 5 OR b <= 5 OR c <= 5""")
def recall_topk_union(spark, sf_dir):
    return discovery.recalled(cut(_scores(spark, sf_dir)), ["contain", "idf", "tfidf"], 5).select(F.col("d").alias("doc_id"), F.col("u").alias("item_id"))


def _decisions(spark, sf_dir) -> DataFrame:
    ranked = _scores(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("score"), "u")))
    down = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"))
    return discovery.decided(ranked, down, LATIN)


_DECIDED = f"""WITH {_SCORES}, k AS (SELECT d, u, score, row_number() OVER (PARTITION BY d ORDER BY score DESC, u) AS r FROM sc),
 m AS (SELECT d, max(score) FILTER (WHERE r = 1) AS main, max(score) FILTER (WHERE r = 2) AS second FROM k GROUP BY d),
 rel AS (SELECT k.d, k.u, k.score, k.r, row_number() OVER (PARTITION BY k.d ORDER BY k.r) AS place FROM k JOIN m USING (d) WHERE main >= 0.2 AND (r = 1 OR score >= greatest(0.2, 0.85 * main)))"""


@query(f"""{_DECIDED} SELECT doc_id, CASE WHEN main >= 0.2 THEN 'traced' ELSE 'untraced' END AS status, coalesce(main >= 0.2 AND main - second < 0.05, FALSE) AS ambiguous,
 CAST(coalesce(n, 0) AS BIGINT) AS n_relations, first_item, first_score
FROM documents LEFT JOIN m ON d = doc_id LEFT JOIN (SELECT d, count(*) AS n, min(u) FILTER (WHERE place = 1) AS first_item, max(score) FILTER (WHERE place = 1) AS first_score FROM rel WHERE place <= 3 GROUP BY d) x ON x.d = doc_id""")
def discover_decide(spark, sf_dir):
    first = F.get(F.col("relations"), F.lit(0))
    return _decisions(spark, sf_dir).select(F.col("d").alias("doc_id"), "status", "ambiguous", long(F.greatest(F.coalesce(F.size("relations"), F.lit(0)), F.lit(0))).alias("n_relations"), first["u"].alias("first_item"), first["score"].alias("first_score"))


@query(f"""{_DECIDED} SELECT doc_id, CAST(k.r AS INTEGER) AS rank, k.u AS item_id, k.score FROM documents JOIN m ON m.d = doc_id JOIN k ON k.d = doc_id WHERE main < 0.2 AND k.r <= 3""")
def discover_untraced(spark, sf_dir):
    rows = _decisions(spark, sf_dir).filter("status = 'untraced'").select("d", F.explode("references").alias("r"))
    return rows.select(F.col("d").alias("doc_id"), "r.rank", F.col("r.u").alias("item_id"), "r.score")


# ---- vectors ----------------------------------------------------------------------------------


@query("""WITH m AS (SELECT label, list(s ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)
SELECT vec_id, m.label AS best, round(c, 6) AS cosine FROM (SELECT vec_id, arg_max(m.label, list_dot_product(CAST(embedding AS DOUBLE[]), v)) AS label, max(list_dot_product(CAST(embedding AS DOUBLE[]), v)) AS c FROM embeddings, m GROUP BY vec_id) m""")
def cosine_top(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = e.groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(64))).alias("v"))
    rows = e.select("vec_id", "embedding").crossJoin(F.broadcast(means)).withColumn("c", V.dot(F.col("embedding"), F.col("v")))
    return rows.groupBy("vec_id").agg(F.max_by("label", "c").alias("best"), six(F.max("c")).alias("cosine"))


def _letters(texts: list[str]) -> np.ndarray:
    """An encoder that SQL can express: how often each of eight letters occurs."""
    return np.array([[text.count(c) for c in "abcdefgh"] for text in texts], "float32").reshape(-1, 8)


def _letter_vectors(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    return discovery.unit_vectors(docs, _letters, 8)


_LETTER_VECTORS = f"""pieces AS (SELECT doc_id, unnest(CASE WHEN length(text) <= 300 OR len(s) = 0 THEN [text] ELSE s END) AS p FROM (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。；;！!？?\n]+'), lambda x: {STRIPPED('x')}), lambda x: length(x) >= 4) AS s FROM documents)),
 sums AS (SELECT doc_id, c, sum(greatest(length(p), 1) * (length(p) - length(replace(p, c, '')))) AS s FROM pieces, (SELECT unnest(string_split('abcdefgh', '')) AS c) GROUP BY doc_id, c),
 vecs AS (SELECT doc_id, c, s / (sqrt(sum(s * s) OVER (PARTITION BY doc_id)) + 1e-9) AS x FROM sums)"""


@query(f"WITH {_LETTER_VECTORS} SELECT doc_id, round(max(x) FILTER (WHERE c = 'a'), 6) AS a, round(max(x) FILTER (WHERE c = 'e'), 6) AS e, round(sum(x), 6) AS total FROM vecs GROUP BY doc_id")
def weighted_mean_vec(spark, sf_dir):
    v = F.col("vec")
    return _letter_vectors(spark, sf_dir).select(F.col("uid").alias("doc_id"), six(v[0]).alias("a"), six(v[4]).alias("e"), six(F.aggregate(v, F.lit(0.0), lambda t, x: t + x)).alias("total"))


@query(f"WITH {_LETTER_VECTORS} SELECT a.doc_id AS d, b.doc_id AS u, round(sum(a.x * b.x), 6) AS sem FROM vecs a JOIN vecs b ON b.doc_id = a.doc_id + 1 AND a.c = b.c GROUP BY a.doc_id, b.doc_id")
def whole_cosine(spark, sf_dir):
    vectors = cut(_letter_vectors(spark, sf_dir))
    pairs = vectors.select(F.col("uid").alias("d"), (F.col("uid") + 1).alias("u"))
    return discovery.whole_cosines(pairs, vectors, vectors).select("d", "u", six(F.col("sem")).alias("sem"))


@query("""WITH e AS (SELECT vec_id, vec_id // 10 AS unit, 4 + vec_id % 9 AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT a.unit AS d, b.unit AS u, a.vec_id, any_value(a.n) AS n, max(list_dot_product(a.v, b.v)) AS b FROM e a JOIN e b ON b.unit = a.unit + 1 GROUP BY a.unit, b.unit, a.vec_id)
SELECT d, u, round(max(b), 6) AS peak, round(sum(CASE WHEN b >= 0.1 THEN n ELSE 0 END) / sum(n), 6) AS cover FROM p GROUP BY d, u""")
def asym_cover(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("unit", F.expr("vec_id div 10"))
    sents = e.groupBy("unit").agg(F.collect_list(F.struct((4 + F.col("vec_id") % 9).alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))).alias("sents"), F.count("*").alias("length"))
    sides = lambda length: sents.select(F.col("unit").alias("uid"), F.lit(length).alias("length"), "sents")
    pairs = sents.select(F.col("unit").alias("d"), (F.col("unit") + 1).alias("u"), F.lit(0.0).alias("sem"))
    found = discovery.asymmetric_semantics(pairs, sides(1), sides(2), tau=0.1)
    return found.select("d", "u", six(F.col("peak")).alias("peak"), six(F.col("cover")).alias("cover"))


@query("""SELECT vec_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS first FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)""")
def softmax_three(spark, sf_dir):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", six(V.softmax(logits)[0]).alias("first"))


# ---- windows ----------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""")
def fill_down(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary"))).otherwise("").alias("asked"))
    return relations.filled_down(rows, ["conv_id"], ["turn"], "asked")


@query(r"""SELECT page_id, CAST(o - 1 AS BIGINT) AS ord, CAST(length(c) AS BIGINT) AS chars FROM (SELECT page_id, unnest(s[2:]) AS c, generate_subscripts(s[2:], 1) AS o FROM (SELECT page_id, regexp_split_to_array(html, '<p>') AS s FROM pages))""")
def slice_between(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    return units.sliced(pages, "<p>").select(F.col("doc").alias("page_id"), long("ord").alias("ord"), long(F.length("content")).alias("chars"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders) WHERE b IS NULL OR o_totalprice > b""")
def monotonic_skeleton(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return units.monotonic_skeleton(rows, ["o_custkey"], "o_orderkey", "o_totalprice")


_EVENTS = "(SELECT event_type || (user_id % 50) AS downstream_id, event_id AS ord, user_id % 3 AS part FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("downstream_id"), F.col("event_id").alias("ord"), (F.col("user_id") % 3).alias("part"))


@query(f"""SELECT part, downstream_id, CAST(row_number() OVER (PARTITION BY part ORDER BY f) AS INTEGER) AS seq FROM (SELECT part, downstream_id, min(ord) AS f FROM {_EVENTS} GROUP BY part, downstream_id)""")
def first_seen_seq(spark, sf_dir):
    return relations.sequenced(_events(spark, sf_dir), ["part"]).select("part", "downstream_id", "seq").distinct()


@query(f"""SELECT part, downstream_id, count(*) AS group_size FROM {_EVENTS} GROUP BY part, downstream_id HAVING count(*) > 1""")
def merge_groups(spark, sf_dir):
    return relations.sequenced(_events(spark, sf_dir), ["part"]).filter("merged").select("part", "downstream_id", "group_size").distinct()


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n, list(n_chars) OVER (PARTITION BY source) AS l FROM documents) WHERE n <= 5 OR n_chars >= greatest(20, 0.15 * list_sort(l)[(n // 2) + 1])""")
def median_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return units.upper_median_filter(rows, ["source"], "n_chars").select("source", "doc_id", "n_chars")


@query(f"""WITH l AS (SELECT source, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS s FROM documents)),
 f AS (SELECT source, doc_id, i, line, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, i) AS n FROM (SELECT source, doc_id, i, {STRIPPED('line')} AS line FROM l) WHERE line <> '')
SELECT source, md5(string_agg(line, chr(10) ORDER BY doc_id, i)) AS merged_md5 FROM f WHERE n = 1 GROUP BY source""")
def dup_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda p: p["text"]).alias("parts"))
    return docs.select("source", F.md5(units.merged_lines(F.col("parts")).cast("binary")).alias("merged_md5"))


_LINES = "l AS MATERIALIZED (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {_LINES}, p AS (SELECT source, count(DISTINCT page) AS n FROM l GROUP BY source),
 s AS (SELECT source, line, count(DISTINCT page) AS pages, max(page) - min(page) AS reach FROM l WHERE length(line) BETWEEN 1 AND 60 AND NOT regexp_matches(line, '[。！？；，、]$') AND NOT regexp_matches(line, '{units.LISTED_LINE}') AND NOT regexp_matches(line, '{T.ITEM_ID}') GROUP BY source, line)
SELECT source, line, pages FROM s JOIN p USING (source) WHERE n >= 3 AND pages >= greatest(3, floor(0.02 * n)) AND reach >= greatest(1, floor(0.1 * n))""")
def repeat_line_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return units.repeated_lines(lines, ["source"], "page", "line", share=0.02, span=0.1)


@query("""SELECT user_id, event_type, start, length FROM (SELECT user_id, event_type, min(pos) AS start, count(*) AS length FROM (SELECT user_id, event_type, pos, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS i FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)) GROUP BY user_id, event_type, i)""")
def island_runs(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", long(pos).alias("pos"))
    return matrix.run_lengths(rows, ["user_id"], "event_type").select("user_id", "event_type", "start", "length")


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN p IS NULL OR l_extendedprice - p > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS clusters FROM (SELECT l_orderkey, l_extendedprice, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS p FROM lineitem) GROUP BY l_orderkey""")
def x_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return layout.clusters(rows, ["l_orderkey"], "l_extendedprice", 5000.0).groupBy("l_orderkey").agg(F.max("cluster").alias("clusters"))


@query("""SELECT a.event_id, max(b.event_id) AS parent FROM (SELECT event_id, user_id, CAST(1 + event_id % 6 AS INTEGER) AS level FROM events) a LEFT JOIN (SELECT event_id, user_id, CAST(1 + event_id % 6 AS INTEGER) AS level FROM events) b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.level < a.level GROUP BY a.event_id""")
def heading_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (1 + F.col("event_id") % 6).cast("int").alias("level"))
    return layout.parents(rows, ["user_id"], "event_id", "level").select("event_id", "parent")


# ---- joins ------------------------------------------------------------------------------------

def _customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("upstream_content"), F.col("c_mktsegment").alias("upstream_doc"))
    rel = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 97 == 0, 10_000_000).otherwise(0)).alias("k"), F.col("o_orderpriority").alias("downstream_doc"), F.col("o_orderkey").cast("string").alias("downstream_id"))
    return items, rel


_REL = "(SELECT o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 10000000 ELSE 0 END AS k, o_orderkey, o_orderpriority FROM orders) r"


@query(f"""SELECT c_custkey AS k, count(o_orderkey) AS relations, count(o_orderkey) > 0 AS has_trace, CASE WHEN count(o_orderkey) > 0 THEN md5(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderpriority, CAST(o_orderkey AS VARCHAR))) ELSE 'NA' END AS shown FROM customer LEFT JOIN {_REL} ON k = c_custkey GROUP BY c_custkey""")
def forward_left(spark, sf_dir):
    rows = matrix.forward(*_customers(spark, sf_dir), ["k"])
    return rows.select("k", long(F.size("downstream")).alias("relations"), "has_trace", F.when(F.col("has_trace"), F.md5(F.col("shown").cast("binary"))).otherwise(F.col("shown")).alias("shown"))


@query(f"""SELECT coalesce(c_custkey, k) AS k, count(o_orderkey) AS relations, any_value(c_name) AS upstream_content FROM customer FULL JOIN {_REL} ON k = c_custkey GROUP BY 1""")
def forward_full(spark, sf_dir):
    rows = matrix.forward(*_customers(spark, sf_dir), ["k"], keep_orphans=True)
    return rows.select("k", long(F.size("downstream")).alias("relations"), "upstream_content")


@query(f"""SELECT upstream_doc, count(*) AS entries, count(*) FILTER (WHERE n > 0) AS traced, count(*) FILTER (WHERE n = 0) AS untraced, CAST(sum(n) AS BIGINT) AS relations FROM (SELECT c_custkey, any_value(c_mktsegment) AS upstream_doc, count(o_orderkey) AS n FROM customer LEFT JOIN {_REL} ON k = c_custkey GROUP BY c_custkey) GROUP BY ROLLUP (upstream_doc)""")
def forward_coverage(spark, sf_dir):
    items, rel = _customers(spark, sf_dir)
    rows = matrix.forward(items, rel, ["k"]).join(items.select("k", "upstream_doc"), "k")
    return matrix.forward_coverage(rows)


def _hybrid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A table of line items, and discoveries of orders; a third and a fifth of the orders have keys that the other side lacks."""
    rows = table(spark, sf_dir, "lineitem")
    core = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 3 == 0, 10**9).otherwise(0)
    known = rows.select(core.alias("core"), (F.col("l_linenumber") * F.lit(10**8) + F.col("l_partkey")).cast("long").alias("ord"), F.lit("up").alias("upstream_doc"), F.concat(F.lit("<X-A"), F.col("l_partkey") % 10, F.lit(">")).alias("upstream_ref"), F.lit("table").alias("relation_source"), F.lit("").alias("evidence"))
    main = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 5 == 0, 2 * 10**9).otherwise(0)
    found = table(spark, sf_dir, "orders").select(main.alias("core"), F.lit("up").alias("main_doc"), F.lit("item").alias("main_kind"), F.concat(F.lit("<B-A0"), F.col("o_custkey") % 10, F.lit(">")).alias("main_key"), F.lit(0.5).alias("main_score"))
    return known, found


_KNOWN = "known AS (SELECT l_orderkey + CASE WHEN l_orderkey % 3 = 0 THEN 1000000000 ELSE 0 END AS core, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS ord, l_partkey % 10 AS part FROM lineitem)"
_FOUND = "found AS (SELECT o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 2000000000 ELSE 0 END AS core, o_custkey % 10 AS main FROM orders)"


@query(f"WITH {_KNOWN}, {_FOUND} SELECT core, '[added] ' AS evidence, 'hybrid' AS relation_source FROM found WHERE core NOT IN (SELECT core FROM known)")
def hybrid_added(spark, sf_dir):
    known, found = _hybrid(spark, sf_dir)
    rows = found.select("core", F.col("main_key").alias("upstream_ref"), F.lit("").alias("evidence"))
    return matrix.hybrid_added(rows, known).select("core", "evidence", "relation_source")


@query(f"""WITH {_KNOWN}, {_FOUND}, j AS (SELECT core, ord, part, main, max(CASE WHEN part = main THEN 1 ELSE 0 END) OVER (PARTITION BY core) AS hit, row_number() OVER (PARTITION BY core ORDER BY ord) AS r FROM known LEFT JOIN found USING (core))
SELECT core, ord, main IS NOT NULL AND hit = 0 AND r = 1 AS suspicious, CASE WHEN main IS NOT NULL AND hit = 0 AND r = 1 THEN '[suspicious] 发现建议 up:<B-A0' || main || '>(0.50)' ELSE '' END AS evidence FROM j""")
def hybrid_suspicious(spark, sf_dir):
    return matrix.hybrid_suspicious(*_hybrid(spark, sf_dir)).select("core", "ord", "suspicious", "evidence")


@query(f"""WITH {_KNOWN}, {_FOUND} SELECT core, ord, CASE WHEN main IS NULL THEN NULL WHEN main % 4 = 3 THEN 'untraced' WHEN part = main THEN 'agree' WHEN part = (main + 1) % 10 THEN 'secondary' ELSE 'unsupported' END AS consensus FROM known LEFT JOIN found USING (core)""")
def hybrid_consensus(spark, sf_dir):
    known, found = _hybrid(spark, sf_dir)
    n = F.regexp_extract("main_key", r"A0(\d)", 1).cast("long")
    status = found.select("core", F.when(n % 4 == 3, "untraced").otherwise("traced").alias("status"), F.lit(0.4).alias("best"))
    second = F.concat(F.lit("<B-A0"), (n + 1) % 10, F.lit(">"))
    rel = found.select("core", F.lit(1).alias("rank"), F.lit("up").alias("doc"), F.lit("item").alias("kind"), F.col("main_key").alias("key"), F.lit(0.5).alias("score")).unionByName(found.select("core", F.lit(2).alias("rank"), F.lit("up").alias("doc"), F.lit("item").alias("kind"), second.alias("key"), F.lit(0.4).alias("score")))
    return matrix.hybrid_consensus(known, rel, status).select("core", "ord", "consensus")


# ---- colouring, statistics, comparison --------------------------------------------------------


def _levels(spark, sf_dir) -> DataFrame:
    """Every character of each document, coloured by each of three rules: its highest level, as an array by position."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    # lengths alone are dealt out, so that files of many texts don't each become one task
    docs = lengths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.sequence(F.lit(0), F.col("n") - 1).alias("at"))
    level = lambda k: lambda pos: F.when((pos + F.col("doc_id")) % (5 + k) == 0, 3).when((pos + k) % 3 == 0, 2).otherwise(1)
    return docs.select("doc_id", matrix.union_levels([F.transform("at", level(k)) for k in range(3)]).alias("levels"))


_LEVELS = "lv AS MATERIALIZED (SELECT doc_id, pos, max(CASE WHEN (pos + doc_id) % (5 + k) = 0 THEN 3 WHEN (pos + k) % 3 = 0 THEN 2 ELSE 1 END) AS level FROM (SELECT doc_id, unnest(range(0, length(text))) AS pos FROM documents), range(0, 3) r(k) GROUP BY doc_id, pos)"


@query(f"""WITH {_LEVELS} SELECT doc_id, CASE level WHEN 3 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'BLACK' END AS category, CAST(min(pos) AS BIGINT) AS start, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS i FROM lv) GROUP BY doc_id, level, i""")
def union_coloring(spark, sf_dir):
    rows = matrix.stretches(_levels(spark, sf_dir), ["doc_id"], "levels")
    return rows.select("doc_id", matrix.category_at(F.col("level")).alias("category"), long("start").alias("start"), long("length").alias("length"))


@query(f"""WITH {_LEVELS} SELECT doc_id, CASE WHEN g > 0 AND g >= b THEN 'GREEN' WHEN b > 0 THEN 'BLUE' ELSE 'BLACK' END AS category FROM (SELECT doc_id, count(*) FILTER (WHERE level = 3) AS g, count(*) FILTER (WHERE level = 2) AS b FROM lv GROUP BY doc_id)""")
def dominant_category(spark, sf_dir):
    count = lambda level: F.size(F.filter("levels", lambda x: x == level))
    return _levels(spark, sf_dir).select("doc_id", matrix.dominant(count(3), count(2)).alias("category"))


@query("""SELECT lang, count(*) AS items, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(k) AS BIGINT) AS k, round(sum(g) / (sum(g) + sum(b) + sum(k)), 6) AS g_share FROM (SELECT doc_id, lang, quality * n_chars AS g, toxic * n_chars AS b, n_chars AS k FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)""")
def char_stats_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("downstream_id"), F.col("doc_id").alias("ord"), "lang", (F.col("quality") * F.col("n_chars")).alias("g"), (F.col("toxic") * F.col("n_chars")).alias("b"), F.col("n_chars").alias("k"))
    return matrix.character_statistics(rows, "lang").select("lang", "items", "g", "b", "k", six(F.col("g_share")).alias("g_share"))


_SHARE = "SELECT source, sum(CASE WHEN lang = '{0}' THEN 1 ELSE 0 END) AS g, sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN lang NOT IN ('{0}', 'fr') THEN 1 ELSE 0 END) AS k, count(*) AS n FROM documents GROUP BY source"


@query(f"""SELECT source, round(d, 6) AS distance, CASE WHEN round(d, 6) > 0.30 THEN 'large' WHEN round(d, 6) > 0.15 THEN 'medium' WHEN round(d, 6) > 0.05 THEN 'small' ELSE 'none' END AS level FROM (SELECT source, sqrt((x.g / x.n - y.g / y.n) ** 2 + (x.b / x.n - y.b / y.n) ** 2 + (x.k / x.n - y.k / y.n) ** 2) AS d FROM ({_SHARE.format('en')}) x JOIN ({_SHARE.format('de')}) y USING (source))""")
def color_distance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    side = lambda lang: docs.groupBy("source").agg(F.count_if(F.col("lang") == lang).alias("g"), F.count_if(F.col("lang") == "fr").alias("b"), F.count_if(~F.col("lang").isin(lang, "fr")).alias("k"))
    return compare.colour_distance(side("en"), side("de"), ["source"]).select("source", six(F.col("distance")).alias("distance"), "level")


@query("""SELECT coalesce(a.k, b.k) AS k, base, result, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN base IS NOT DISTINCT FROM result THEN 'same' ELSE 'changed' END AS kind FROM (SELECT o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000000 ELSE 0 END AS k, o_orderpriority AS base FROM orders) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS result FROM orders) b ON a.k = b.k""")
def cell_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("value"))
    moved = orders.withColumn("k", F.col("k") + F.when(F.col("k") % 7 == 0, 10**9).otherwise(0))
    return compare.cell_diff(moved, orders.withColumn("value", F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("value"))), ["k"])


@query("""SELECT user_id, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS mismatches FROM (SELECT user_id, pos, sum(CASE WHEN p IS NULL OR pos - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS s FROM (SELECT user_id, pos, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events) WHERE event_type <> 'view')) GROUP BY user_id, s""")
def mismatch_segments(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", long(pos).alias("pos"), F.col("event_type").alias("base"), F.lit("view").alias("result"))
    return compare.mismatch_segments(rows, ["user_id"]).select("user_id", "start", "end", "mismatches")


def _gold(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Line items as candidates of their orders; returned ones are gold, and relations of the highest tax are gold without a candidate."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("u"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), "l_returnflag", "l_tax")
    gold = rows.filter("l_returnflag = 'R'").select("d", "u").unionByName(rows.filter("l_tax >= 0.075").select("d", (-F.col("u")).alias("u")))
    return rows.drop("l_returnflag", "l_tax"), gold


_CAND = "c AS MATERIALIZED (SELECT l_orderkey AS d, l_partkey * 10 + l_linenumber AS u, l_quantity AS a, l_discount AS b, l_returnflag, l_tax FROM lineitem)"
_GOLD = "g AS MATERIALIZED (SELECT DISTINCT d, u FROM (SELECT d, u FROM c WHERE l_returnflag = 'R' UNION ALL SELECT d, -u FROM c WHERE l_tax >= 0.075))"


@query(f"""WITH {_CAND}, {_GOLD}, r AS (SELECT d, u, row_number() OVER (PARTITION BY d ORDER BY a DESC, u) AS rank FROM c)
SELECT count(*) AS relations, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM g LEFT JOIN (SELECT d, u, min(rank) AS rank FROM r GROUP BY d, u) r USING (d, u)""")
def rank_metrics(spark, sf_dir):
    ranked, gold = _gold(spark, sf_dir)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("a"), "u")))
    out = compare.ranking_metrics(ranked, gold)
    return out.select("relations", *(six(F.col(c)).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")))


@query(f"""WITH {_CAND}, {_GOLD}, r AS (SELECT d, u, row_number() OVER (PARTITION BY d ORDER BY a DESC, u) <= 2 AS x, row_number() OVER (PARTITION BY d ORDER BY b DESC, u) <= 2 AS y FROM c)
SELECT count(*) AS relations, round(avg(CAST(coalesce(x, FALSE) AS INTEGER)), 6) AS recall_a, round(avg(CAST(coalesce(y, FALSE) AS INTEGER)), 6) AS recall_b, round(avg(CAST(coalesce(x OR y, FALSE) AS INTEGER)), 6) AS recall_union FROM g LEFT JOIN r USING (d, u)""")
def recall_by_channel(spark, sf_dir):
    ranked, gold = _gold(spark, sf_dir)
    out = compare.recall_by_channel(ranked, gold, ["a", "b"], 2)
    return out.select("relations", *(six(F.col(c)).alias(c) for c in ("recall_a", "recall_b", "recall_union")))


@query(f"""WITH {_CAND}, {_GOLD}, f AS (SELECT DISTINCT d, u FROM c WHERE a >= 30), h AS (SELECT count(*) AS hits FROM f SEMI JOIN g USING (d, u)), n AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold, hits FROM h)
SELECT found, gold, hits, (SELECT count(DISTINCT d) FROM g WHERE d NOT IN (SELECT d FROM f)) AS false_untraced, round(hits / found, 6) AS precision, round(hits / gold, 6) AS recall, round(2 * (hits / found) * (hits / gold) / (hits / found + hits / gold), 6) AS f1 FROM n""")
def decision_metrics(spark, sf_dir):
    ranked, gold = _gold(spark, sf_dir)
    found = ranked.filter("a >= 30")
    status = ranked.groupBy("d").agg(F.when(F.max("a") >= 30, "traced").otherwise("untraced").alias("status"))
    out = compare.decision_metrics(found, gold, status)
    return out.select("found", "gold", "hits", "false_untraced", *(six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_CAND}, {_GOLD}, w AS (SELECT * FROM (VALUES (1, 1.0::DOUBLE, 0.0::DOUBLE), (2, 0.0, 100.0), (3, 1.0, 200.0)) t(grid, wa, wb)), r AS (SELECT grid, d, u, row_number() OVER (PARTITION BY grid, d ORDER BY 0.0 + a * wa + b * wb DESC, u) AS rank FROM c, w)
SELECT CAST(grid AS BIGINT) AS grid, count(*) FILTER (WHERE rank <= 1) AS t1, count(*) FILTER (WHERE rank <= 3) AS t3, count(*) FILTER (WHERE rank <= 5) AS t5, 3 * count(*) FILTER (WHERE rank <= 1) + 2 * count(*) FILTER (WHERE rank <= 3) + count(*) FILTER (WHERE rank <= 5) AS "key" FROM r SEMI JOIN g USING (d, u) GROUP BY grid""")
def weight_grid(spark, sf_dir):
    ranked, gold = _gold(spark, sf_dir)
    weights = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 100.0), (3, 1.0, 200.0)], "grid long, w_a double, w_b double")
    return compare.weight_grid(ranked, gold, weights, ["a", "b"]).select("grid", "t1", "t3", "t5", "key")


_S = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _neighbours(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    return e.join(other, "vec_id").select("vec_id", six(V.dot(F.col("embedding"), F.col("v"))).alias("sim"))


@query(f"""WITH s AS (SELECT a.vec_id, round({_S}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), x AS (SELECT vec_id, abs(sim) * 3 AS c, vec_id % 4 AS t FROM s)
SELECT vec_id, CASE WHEN c < 0.6 THEN 'ignore' WHEN t = 0 THEN 'opinion' WHEN t = 1 THEN 'none' WHEN t = 2 AND c >= 0.85 THEN 'confirm' WHEN t = 2 THEN 'advise' ELSE 'suggest_other' END AS outcome FROM x""")
def verdict_disposition(spark, sf_dir):
    t = F.col("vec_id") % 4
    out = adjudicate.disposition(F.when(t == 0, "suspicious").otherwise("ambiguous"), F.when(t == 1, adjudicate.NONE_LABEL).otherwise("A"), F.abs("sim") * 3, t == 2)
    return _neighbours(spark, sf_dir).select("vec_id", out.alias("outcome"))


@query(f"""WITH s AS (SELECT a.vec_id, least(1, abs(round({_S}, 6)) * 4) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), x AS (SELECT vec_id, sim, vec_id % 100 / 100 AS f, vec_id % 7 / 6 AS e FROM s)
SELECT vec_id, CASE WHEN sim < 0.5 THEN 'BLACK' WHEN sim >= 0.95 AND (f >= 0.92 OR (f >= 0.88 AND f >= 0.8)) AND f >= 0.7 THEN 'GREEN' WHEN vec_id % 31 = 0 THEN 'GREEN' WHEN sim >= 0.85 AND vec_id % 17 = 0 AND f >= 0.5 THEN 'GREEN' WHEN sim >= 0.7 AND 1 - e >= 0.8 THEN 'BLACK' WHEN sim >= 0.7 AND e >= 0.85 AND f >= 0.5 THEN 'BLUE' WHEN sim >= 0.8 AND e >= 0.8 AND f >= 0.5 THEN 'BLUE' WHEN sim >= 0.85 AND (f >= 0.55 OR f >= 0.6) THEN 'BLUE' WHEN sim >= 0.75 AND f >= 0.55 AND f >= 0.45 THEN 'BLUE' ELSE 'BLACK' END AS category FROM x""")
def classify_case(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).select("vec_id", F.least(F.lit(1.0), F.abs("sim") * 4).alias("sim"), (F.col("vec_id") % 100 / 100).alias("f"), (F.col("vec_id") % 7 / 6).alias("e"))
    f, e = F.col("f"), F.col("e")
    category = verify.classified(F.col("sim"), f, f, f, f, F.col("vec_id") % 31 == 0, F.col("vec_id") % 17 == 0, f, e, e, 1 - e)
    return rows.select("vec_id", category.alias("category"))


from spanloom.plans import catalogue_documents, catalogue_layout  # noqa: E402, F401 - they register their queries


# ---- procedures that SQL cannot express -------------------------------------------------------


@query()
def pair_verify(spark, sf_dir):
    pairs = _adjacent(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), F.col("a").alias("down"), F.col("b").alias("up"))
    return verify.verified(pairs)


@query()
def discover_units(spark, sf_dir):
    """The whole discovery, with normal forms, anchors and the encoder, of all documents against all passages."""
    down, up = (cut(side) for side in _profiled_units(spark, sf_dir))
    return discovery.discover(down, up, LATIN)

"""The traceability matrix: rows from tables and decisions, hybrid reconciliation, colouring, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.options import COLOURS, EXTRA_COLOURS, PRIORITY


def category_of(colour: Column) -> Column:
    """[N32] Class of a colour; of eight digits the last six count; unknown ones are BLACK."""
    rgb = F.upper(F.when(F.length(colour) == 8, F.substring(colour, 3, 6)).otherwise(colour))
    found = F.lit("BLACK")
    for code, name in ({v: k for k, v in COLOURS.items()} | EXTRA_COLOURS).items():
        found = F.when(rgb == code, name).otherwise(found)
    return found


def priority(category: Column) -> Column:
    found = F.lit(1)
    for name, value in PRIORITY.items():
        found = F.when(category == name, value).otherwise(found)
    return found


def category_at(level: Column) -> Column:
    return F.when(level == 3, "GREEN").when(level == 2, "BLUE").otherwise("BLACK")


def rows_of_decisions(decisions: DataFrame, down: DataFrame, up: DataFrame, source: str = "discover") -> DataFrame:
    """[X3, N22] A row for each relation of a decision, or one without upstream; rows of one unit share ``seq``.

    The evidence is the relation's, or names the best candidates where there is none.
    """
    d = down.select(F.col("uid").alias("d"), F.col("doc").alias("downstream_doc"), F.col("key").alias("downstream_id"), F.col("content").alias("downstream_content"), F.col("ord").alias("unit_ord"))
    u = up.select(F.col("uid").alias("u"), F.col("doc").alias("upstream_doc"), F.col("key").alias("upstream_ref"), F.col("content").alias("upstream_content"), F.col("kind").alias("upstream_kind"))
    told = "evidence" in decisions.schema["relations"].dataType.elementType.fieldNames()
    evidence = F.col("r.evidence") if told else F.when(F.col("r.score").isNotNull(), F.format_string("score=%.2f", F.col("r.score")))
    flat = decisions.select("d", "status", "ambiguous", F.explode_outer("relations").alias("r")).select("d", "status", "ambiguous", F.col("r.rank").alias("rank"), F.col("r.u").alias("u"), F.coalesce("r.score", F.lit(0.0)).alias("candidate_score"), evidence.alias("evidence"))
    open_ = decisions.filter("status = 'untraced'").select("d", F.explode("references").alias("r")).select("d", "r.rank", "r.u", "r.score").join(u, "u")
    named = open_.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("upstream_doc").alias("doc"), F.col("upstream_ref").alias("key"), "score"))).alias("best"))
    joined = flat.join(d, "d").join(u, "u", "left").join(named, "d", "left")
    none = F.array().cast("array<struct<rank:int,doc:string,key:string,score:double>>")
    joined = joined.withColumn("evidence", F.coalesce("evidence", F.when(F.col("status") == "untraced", T.untraced_evidence(F.coalesce("best", none))), F.lit(""))).drop("best")
    seq = F.dense_rank().over(Window.partitionBy("downstream_doc").orderBy("unit_ord", "d"))
    filled = {c: F.coalesce(c, F.lit("")) for c in ("upstream_doc", "upstream_ref", "upstream_content")}
    return joined.withColumns(filled | {"seq": seq, "relation_source": F.lit(source)})


def _matches(ref: Column, ref_core: Column, kind: Column, key: Column, key_core: Column) -> Column:
    number = lambda c: F.substring_index(T.strip(c), " ", 1)
    return F.when(kind == "section", F.startswith(number(key), number(ref)) | F.startswith(number(ref), number(key))).otherwise(ref_core == key_core)


def matches_unit(ref: Column, kind: Column, key: Column) -> Column:
    """[J11] Whether a reference means a unit: sections by their numbers' beginnings, items by the cores of ids."""
    return _matches(ref, T.id_core(ref), kind, key, T.id_core(key))


def hybrid_added(decided_rows: DataFrame, table: DataFrame, keys: list[str] = ["core"]) -> DataFrame:
    """[J12, U3] Rows found from content whose downstream unit no table row has, marked as added where they name an upstream."""
    fresh = decided_rows.join(table.select(*keys).distinct(), keys, "left_anti")
    mark = F.when(F.col("upstream_ref") != "", F.concat(F.lit("[added] "), F.coalesce("evidence", F.lit("")))).otherwise(F.col("evidence"))
    return fresh.withColumns({"evidence": mark, "relation_source": F.lit("hybrid")})


def hybrid_suspicious(table: DataFrame, mains: DataFrame, keys: list[str] = ["core"]) -> DataFrame:
    """[J13] Table rows; of a unit none of whose rows names its decision's main relation, the first says so.

    ``table`` has the keys, ``ord``, ``upstream_doc``, ``upstream_ref``, ``relation_source``,
    ``evidence``; ``mains`` the keys, ``main_doc``, ``main_kind``, ``main_key``, ``main_score``.
    """
    # cores are made on each side before the join, not for every pair after it
    both = table.withColumn("_core", T.id_core(F.col("upstream_ref"))).join(mains.withColumn("_main_core", T.id_core(F.col("main_key"))), keys, "left")
    hit = (F.col("upstream_ref") != "") & (F.col("upstream_doc") == F.col("main_doc")) & _matches(F.col("upstream_ref"), F.col("_core"), F.col("main_kind"), F.col("main_key"), F.col("_main_core"))
    group = Window.partitionBy(*keys)
    missed = F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(group) == 0
    first = F.row_number().over(group.orderBy(F.when(F.col("relation_source") == "table", 0).otherwise(1), "ord")) == 1
    marked = F.col("main_key").isNotNull() & missed & first & (F.col("relation_source") == "table")
    note = F.concat(F.lit("[suspicious] 发现建议 "), "main_doc", F.lit(":"), F.substring("main_key", 1, 30), F.format_string("(%.2f)", "main_score"))
    flagged = both.withColumn("suspicious", marked)
    return flagged.withColumns({"evidence": F.when(F.col("suspicious"), note).otherwise(F.col("evidence")), "relation_source": F.when(F.col("suspicious"), "hybrid").otherwise(F.col("relation_source"))}).drop("main_doc", "main_kind", "main_key", "main_score", "_core", "_main_core")


def hybrid_consensus(table: DataFrame, relations: DataFrame, statuses: DataFrame, keys: list[str] = ["core"]) -> DataFrame:
    """[J14] Table rows with what the decision on their unit says: agree, secondary, unsupported or untraced.

    ``relations`` has the keys, ``rank``, ``doc``, ``kind``, ``key``, ``score``; ``statuses`` the keys,
    ``status`` and ``best`` (highest score). Units without a decision stay unmarked. A decision's few
    relations become one array a unit, with the cores of their ids, so the table is shuffled once.
    """
    named = relations.select(*keys, F.struct("rank", "score", "doc", "kind", "key", T.id_core(F.col("key")).alias("core_of_key")).alias("r"))
    listed = named.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("rels"))
    marked = table.withColumn("_core", T.id_core(F.col("upstream_ref"))).join(statuses.join(listed, keys, "left"), keys, "left")
    same = lambda r: (F.col("upstream_ref") != "") & (F.col("upstream_doc") == r["doc"]) & _matches(F.col("upstream_ref"), F.col("_core"), r["kind"], r["key"], r["core_of_key"])
    marked = marked.withColumn("_hit", F.get(F.filter("rels", same), F.lit(0)))
    outcome = F.when(F.col("status").isNull(), None).when(F.col("status") != "traced", "untraced").when(F.col("_hit.rank") == 1, "agree").when(F.col("_hit.rank") > 1, "secondary").otherwise("unsupported")
    note = F.when(F.col("consensus") == "untraced", F.concat(F.lit("发现层未溯源"), F.when(F.col("best").isNotNull(), F.format_string("(%.2f)", "best")).otherwise(""))).when(F.col("consensus") == "agree", F.format_string("发现层一致(%.2f)", "_hit.score")).when(F.col("consensus") == "secondary", "发现层次要支持").when(F.col("consensus") == "unsupported", "发现层未支持")
    return marked.withColumn("consensus", outcome).withColumn("evidence", F.concat_ws(" ", F.when(F.col("evidence") != "", F.col("evidence")), note)).drop("status", "best", "rels", "_core", "_hit")


def character_categories(runs: DataFrame, keys: list[str]) -> DataFrame:
    """[A20] One row for each character of coloured runs: keys, ``pos`` from 0, ``level``. ``runs`` is an array of text and category."""
    listed = runs.select(*keys, F.posexplode("runs").alias("run", "r"))
    start = F.sum(F.length("r.text")).over(Window.partitionBy(*keys).orderBy("run")) - F.length("r.text")
    spans = listed.select(*keys, start.alias("start"), F.length("r.text").alias("n"), priority(F.col("r.category")).alias("level")).filter("n > 0")
    return spans.select(*keys, "level", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))


def run_lengths(characters: DataFrame, keys: list[str], value: str = "level") -> DataFrame:
    """[A6, W5] Neighbouring positions of one value as one stretch: keys, ``start``, ``length``, the value."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys, value).orderBy("pos"))
    return characters.withColumn("_i", island).groupBy(*keys, value, "_i").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("_i")


def union_colouring(characters: DataFrame, keys: list[str]) -> DataFrame:
    """[A6] Of several colourings of one text, each character's highest class, as stretches."""
    best = characters.groupBy(*keys, "pos").agg(F.max("level").alias("level"))
    return run_lengths(best, keys).withColumn("category", category_at(F.col("level")))


def union_levels(colourings: list[Column]) -> Column:
    """[A6] Of arrays of levels by position, one for each colouring of one text: each position's highest level."""
    best = colourings[0]
    for other in colourings[1:]:
        best = F.zip_with(best, other, lambda a, b: F.greatest(a, b))
    return best


def stretches(rows: DataFrame, keys: list[str], levels: str) -> DataFrame:
    """[A6] Arrays of levels by position as stretches of one level: keys, which tell rows apart, ``start``, ``length``, ``level``.

    Positions become rows, sorted within each key, and only those where a stretch begins go on; rows
    that are already dealt out by the keys are not shuffled.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    placed = rows.select(*keys, F.size(levels).alias("n"), F.posexplode(levels).alias("start", "level"))
    before = F.lag("level").over(order)
    begins = placed.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("level")))
    length = F.coalesce(F.lead("start").over(order), F.col("n")) - F.col("start")
    return begins.select(*keys, "start", length.alias("length"), "level")


def dominant(green: Column, blue: Column) -> Column:
    """[A7] GREEN if there is any and no more BLUE; else BLUE if there is any; else BLACK."""
    return F.when((green > 0) & (green >= blue), "GREEN").when(blue > 0, "BLUE").otherwise("BLACK")


def overall(rows: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """[A8] The highest class of a group."""
    return rows.groupBy(*keys).agg(category_at(F.max(priority(F.col(category)))).alias("overall"))


def character_statistics(rows: DataFrame, doc: str = "downstream_doc") -> DataFrame:
    """[A10] Characters by class, and shares, for each document and, in a row of null, for all.

    ``rows`` has ``downstream_id``, ``ord`` and counts ``g``, ``b``, ``k``; of rows of the same id only the first counts.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("downstream_id").orderBy("ord"))).filter("_n = 1")
    sums = first.rollup(doc).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in "gbk"))
    total = F.col("g") + F.col("b") + F.col("k")
    return sums.withColumns({f"{c}_share": F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in "gbk"})


def outcome_counts(rows: DataFrame) -> DataFrame:
    """[A11] How many rows were added, made suspicious, agreed on or left alone."""
    has = lambda mark: F.count_if(F.col("evidence").contains(mark))
    return rows.agg(F.count("*").alias("rows"), has("[added]").alias("added"), has("[suspicious]").alias("suspicious"), has("发现层一致").alias("agreed"), F.count_if("ambiguous").alias("ambiguous"))


def forward(items: DataFrame, relations: DataFrame, keys: list[str], keep_orphans: bool = False) -> DataFrame:
    """[J7, J8, K2] Upstream items with what refers to them, in order; ``NA`` where nothing does.

    With ``keep_orphans`` relations to no known item stay as rows of their own; else they are lost.
    """
    joined = items.join(relations, keys, "full_outer" if keep_orphans else "left")
    ds = F.sort_array(F.collect_list(F.when(F.col("downstream_id").isNotNull(), F.struct("downstream_doc", "downstream_id"))))
    out = joined.groupBy(*keys).agg(F.first("upstream_content", ignorenulls=True).alias("upstream_content"), ds.alias("downstream"))
    return out.withColumns({"has_trace": F.size("downstream") > 0, "shown": F.when(F.size("downstream") > 0, F.array_join(F.transform("downstream", lambda d: d["downstream_id"]), "\n")).otherwise("NA")})


def forward_coverage(entries: DataFrame, doc: str = "upstream_doc") -> DataFrame:
    """[A12] Entries, traced, untraced and relations of each document and, in a row of null, of all."""
    return entries.rollup(doc).agg(F.count("*").alias("entries"), F.count_if("has_trace").alias("traced"), F.count_if(~F.col("has_trace")).alias("untraced"), F.sum(F.size("downstream")).alias("relations"))


def inferred_design_doc(names: DataFrame, docs: DataFrame) -> DataFrame:
    """[X5] The design document of which the name holds the first four characters, else the first of all.

    Beginnings are looked up among the name's own stretches of four characters, by equality.
    """
    begins = docs.select(F.substring("doc", 1, 4).alias("part"), "doc", "doc_ord").groupBy("part").agg(F.min(F.struct("doc_ord", "doc")).alias("first"))
    chars = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    parts = names.select("name").distinct().withColumn("part", F.explode(F.array_distinct(F.concat(*(chars(F.col("name"), n) for n in (1, 2, 3, 4))))))
    found = parts.join(begins, "part").groupBy("name").agg(F.min("first").alias("first"))
    fallback = docs.agg(F.min(F.struct("doc_ord", "doc")).alias("any"))  # one row
    return names.select("name").distinct().join(found, "name", "left").join(F.broadcast(fallback)).select("name", F.coalesce("first.doc", "any.doc").alias("doc")).filter(F.col("doc").isNotNull())

"""Whole pipelines: backward matrices by table, by content or both; forward matrices; review.

All documents go through one plan, keyed by ``doc``; nothing loops over them on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import discovery, forward as ahead, matrix, relations, units, verify
from spanloom.options import DiscoveryOptions, MatchOptions
from spanloom.session import cut

MODES = ("table", "discover", "hybrid")


def identified(units_: DataFrame, salt: int) -> DataFrame:
    """Units with a ``uid`` of their own: keys may repeat, so ids come from all that tells units apart."""
    return units_.withColumn("uid", F.xxhash64(F.lit(salt), "doc", "kind", "ord", "key"))


def from_tables(rels: DataFrame, down: DataFrame, up: DataFrame, both_ways: bool = True, by_items: bool = False) -> DataFrame:
    """[X1, X2: table mode] Matrix rows of declared relations: both contents resolved, numbered by first appearance.

    References are resolved by all tiers, the ratio last; ``by_items`` adds the chain of ids and their cores.

    ``rels`` is what :func:`spanloom.operators.relations.parsed_relations` gives; ``down`` and ``up`` are
    documents ``doc``, ``text``.
    """
    keys = cut(relations.content_keys(units.items(up), units.sections(up)))
    names = relations.matched_names(rels.select(F.col("upstream_doc").alias("name")).filter("name <> ''"), up.select("doc", F.xxhash64("doc").alias("doc_ord")))
    placed = relations.joined_items(rels, units.items(down), both_ways).withColumnsRenamed({"doc": "downstream_doc", "upstream_doc": "name"})
    named = placed.join(names.withColumnRenamed("doc", "upstream_doc"), "name", "left").withColumn("upstream_doc", F.coalesce("upstream_doc", "name")).drop("name")
    asked = named.select(F.col("upstream_doc").alias("doc"), F.col("upstream_ref").alias("ref"))
    if by_items:
        found = relations.resolved_by_chain(asked, keys, units.items(up))
    else:
        asked = cut(asked.distinct())
        found = cut(relations.resolved(asked, keys).select("doc", "ref", "content"))
        found = found.unionByName(relations.resolved_fuzzily(asked.join(found.select("doc", "ref"), ["doc", "ref"], "left_anti"), keys).select("doc", "ref", "content"))
    contents = found.select(F.col("doc").alias("upstream_doc"), F.col("ref").alias("upstream_ref"), F.col("content").alias("upstream_content"))
    rows = named.join(contents, ["upstream_doc", "upstream_ref"], "left")
    rows = rows.withColumns({"upstream_content": F.coalesce("upstream_content", F.lit("")), "relation_source": F.lit("table"), "evidence": F.lit(""), "candidate_score": F.lit(0.0), "ambiguous": F.lit(False)})
    return relations.sequenced(cut(rows), ["downstream_doc"])


def from_content(down: DataFrame, up: DataFrame, o: DiscoveryOptions = DiscoveryOptions(), latin: bool = False, encoder: discovery.Encoder = discovery.hashed_grams, dimensions: int = 256) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """[X11, discover mode] Matrix rows found from content, the decisions, and the units of both sides."""
    # units are read by every channel: extract them once
    d = cut(discovery.profiled(identified(units.units(down, "downstream"), 1), latin))
    u = cut(discovery.profiled(identified(units.units(up, "upstream"), 2), latin))
    decisions = cut(discovery.discover(d, u, o, encoder, dimensions))
    return matrix.rows_of_decisions(decisions, d, u), decisions, d, u


COLUMNS = ("downstream_doc", "seq", "downstream_id", "downstream_content", "upstream_doc", "upstream_ref", "upstream_content", "relation_source", "candidate_score", "evidence", "ambiguous")


def backward(down: DataFrame, up: DataFrame, rels: DataFrame | None = None, mode: str = "table", design: bool = False, o: DiscoveryOptions = DiscoveryOptions(), encoder: discovery.Encoder = discovery.hashed_grams, dimensions: int = 256) -> DataFrame:
    """[X1, X2] The backward matrix of all downstream documents in one of the three modes.

    ``design`` is for design documents against one of system requirements: downstream ids may be parts of
    items' ids only, and references are resolved by items' ids and cores as well.
    """
    declare = lambda: from_tables(rels, down, up, both_ways=not design, by_items=design)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "discover" and rels is None:
        raise ValueError("table and hybrid mode need relations")
    if mode == "table":
        return declare().select(*COLUMNS)
    found, decisions, d, u = from_content(down, up, o, encoder=encoder, dimensions=dimensions)
    if mode == "discover":
        return found.select(*COLUMNS)
    keys = ["downstream_doc", "core"]
    declared = declare().withColumn("core", T.id_core(F.col("downstream_id")))
    unit = u.select(F.col("uid").alias("u"), "doc", "kind", "key")
    own = d.select(F.col("uid").alias("d"), F.col("doc").alias("downstream_doc"), T.id_core(F.col("key")).alias("core"))
    listed = decisions.select("d", F.explode("relations").alias("r")).select("d", "r.rank", "r.u", "r.score").join(unit, "u").join(own, "d").select(*keys, "rank", "doc", "kind", "key", "score")
    status = decisions.join(own, "d").select(*keys, "status", F.array_max(F.transform(F.coalesce("references", F.array()), lambda x: x["score"])).alias("best"))
    main = listed.filter("rank = 1").select(*keys, F.col("doc").alias("main_doc"), F.col("kind").alias("main_kind"), F.col("key").alias("main_key"), F.col("score").alias("main_score"))
    noted = matrix.hybrid_suspicious(matrix.hybrid_consensus(declared, listed, status, keys), main, keys)
    added = matrix.hybrid_added(found.withColumn("core", T.id_core(F.col("downstream_id"))), declared, keys)
    last = declared.groupBy("downstream_doc").agg(F.max("seq").alias("last"))
    added = added.join(last, "downstream_doc", "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0)))
    return noted.select(*COLUMNS).unionByName(added.select(*COLUMNS))


def verified(rows: DataFrame, encoder=discovery.hashed_grams, entailment=verify.undecided, o: MatchOptions = MatchOptions()) -> DataFrame:
    """[P1, X12] Matrix rows with the runs of both contents and the overall class; equal pairs are verified once."""
    numbered = rows.withColumn("pair_id", F.xxhash64("downstream_content", "upstream_content"))
    pairs = numbered.select("pair_id", F.col("downstream_content").alias("down"), F.col("upstream_content").alias("up")).dropDuplicates(["pair_id"])
    return numbered.join(verify.verified(pairs, encoder, entailment, o).withColumnRenamed("error", "verify_error"), "pair_id").drop("pair_id")


def design_relations(tables: DataFrame, upstream_doc: str = relations.SYSTEM_DOC) -> DataFrame:
    """[X2] Relations of design documents from their tables: those headed as such, on the last pages with tables, continued over pages."""
    headed = relations.last_pages(relations.sane_tables(tables), 8, of_tables=True).filter(relations.is_design_header(F.col("headers")))
    return relations.parsed_design_relations(relations.continued_tables(headed), upstream_doc)


def forward(rows: DataFrame, up: DataFrame, keep_orphans: bool = False) -> DataFrame:
    """[X4, J5, J6] The forward matrix: every entry of upstream documents with the downstream units whose references mean it.

    ``rows`` are of a backward matrix: ``upstream_doc`` as named there, ``upstream_ref``, ``upstream_content``,
    ``downstream_doc``, ``downstream_id``. A traced entry shows the content that its rows have. Rows whose
    reference means no entry are orphans.
    """
    found = cut(ahead.entries(up))
    docs = up.select("doc", F.xxhash64("doc").alias("doc_ord"))
    told = cut(rows.filter("upstream_ref <> ''").select(F.col("upstream_doc").alias("name"), F.col("upstream_ref").alias("ref"), F.col("upstream_content").alias("said"), "downstream_doc", "downstream_id"))
    meant = ahead.matched_entries(told, ahead.entry_keys(found), docs)
    placed = told.join(meant.join(found.select("doc", "ord", "key"), ["doc", "ord"]), ["name", "ref"], "left")
    rel = placed.select(F.coalesce("doc", "name").alias("upstream_doc"), F.coalesce("key", "ref").alias("upstream_ref"), "said", "downstream_doc", "downstream_id")
    items = found.select(F.col("doc").alias("upstream_doc"), F.col("key").alias("upstream_ref"), F.col("content").alias("upstream_content"))
    keys = ["upstream_doc", "upstream_ref"]
    shown = rel.filter("said <> ''").groupBy(*keys).agg(F.min_by("said", F.struct("downstream_doc", "downstream_id", "said")).alias("said"))
    out = matrix.forward(items, rel.drop("said"), keys, keep_orphans)
    return out.join(shown, keys, "left").withColumn("upstream_content", F.coalesce("said", "upstream_content")).drop("said")


def forward_verified(rows: DataFrame, up: DataFrame, encoder=discovery.hashed_grams, entailment=verify.undecided, o: MatchOptions = MatchOptions()) -> DataFrame:
    """[X4 for design documents] Backward rows verified anew against the upstream documents' own text, the saved one only where that is empty."""
    found = cut(ahead.entries(up))
    docs = up.select("doc", F.xxhash64("doc").alias("doc_ord"))
    asked = rows.select(F.col("upstream_doc").alias("name"), F.col("upstream_ref").alias("ref")).filter("ref <> ''")
    meant = ahead.matched_entries(asked, ahead.entry_keys(found), docs).join(found.select("doc", "ord", "content"), ["doc", "ord"]).select(F.col("name").alias("upstream_doc"), F.col("ref").alias("upstream_ref"), "content")
    fresh = rows.join(meant, ["upstream_doc", "upstream_ref"], "left").withColumn("upstream_content", F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("upstream_content"))).drop("content")
    return verified(fresh, encoder, entailment, o)


def references_verified(decisions: DataFrame, down: DataFrame, up: DataFrame, encoder=discovery.hashed_grams, entailment=verify.undecided, o: MatchOptions = MatchOptions()) -> DataFrame:
    """[X12] The reference candidates of untraced units, verified on demand: ``d``, ``u``, ``rank``, runs and the overall class."""
    pairs = decisions.filter("status = 'untraced'").select("d", F.explode("references").alias("r")).select("d", "r.rank", "r.u")
    texts = pairs.join(down.select(F.col("uid").alias("d"), F.col("content").alias("down")), "d").join(up.select(F.col("uid").alias("u"), F.col("content").alias("up")), "u").withColumn("pair_id", F.xxhash64("d", "u"))
    return texts.select("d", "u", "rank", "pair_id").join(verify.verified(texts, encoder, entailment, o), "pair_id").drop("pair_id")


def shown_rows(rows: DataFrame, source: str | None = None, search: str = "", category: str | None = None) -> DataFrame:
    """[F14, K12] Rows of a matrix for a preview: of one source, with ``search`` in the downstream id in either case, of one overall class."""
    if source is not None:
        rows = rows.filter(F.col("relation_source") == source)
    if search.strip():
        rows = rows.filter(F.upper("downstream_id").contains(search.strip().upper()))
    return rows if category is None else rows.filter(F.col("overall") == category)

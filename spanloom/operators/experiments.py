"""Experimental channels and harnesses of discovery: variants that the shipped fusion does not use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vector as V
from spanloom.operators import discovery
from spanloom.options import DiscoveryOptions

#: Fixed value: a technical label.
LABEL = r"^[A-Za-z][A-Za-z0-9\-/.]+$"


def rare_hits(down: DataFrame, up: DataFrame, statistics: DataFrame) -> DataFrame:
    """[E1] Of pairs that share a rare token: ``precision`` and ``recall`` of rare weights, ``f1``, ``f2`` and ``best``.

    Precision is the share of the downstream unit's rare weight that the upstream unit has, recall the other way.
    """
    recall = discovery.rare_hit_pairs(down, up, statistics).select("d", "u", F.col("idf").alias("recall"))
    precision = discovery.rare_hit_pairs(up, down, statistics).select(F.col("u").alias("d"), F.col("d").alias("u"), F.col("idf").alias("precision"))
    p, r = F.col("precision"), F.col("recall")
    return precision.join(recall, ["d", "u"]).withColumns({"f1": 2 * p * r / (p + r), "f2": 5 * p * r / (4 * p + r), "best": F.greatest(p, r)})


def rare_labels(down: DataFrame, up: DataFrame, statistics: DataFrame, pattern: str = LABEL) -> DataFrame:
    """[E1] Jaccard similarity of the rare tokens that look like labels, of pairs that share one: ``d``, ``u``, ``labels``."""
    rare = statistics.filter("rare").filter(F.col("token").rlike(pattern)).select("token")
    side = lambda df, s: df.select(F.col("uid").alias(s), F.explode(F.array_distinct("tokens")).alias("token")).join(rare, "token")
    a, b = side(down, "d"), side(up, "u")
    shared = a.join(b, "token").groupBy("d", "u").agg(F.count("*").alias("n"))
    counted = shared.join(a.groupBy("d").agg(F.count("*").alias("na")), "d").join(b.groupBy("u").agg(F.count("*").alias("nb")), "u")
    return counted.select("d", "u", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("labels"))


def base_score(fine: Column, contain: Column, rare: Column, weights: tuple[float, float, float] = (0.5, 0.2, 0.3)) -> Column:
    """[E1] Semantics, containment and a rare-word mode, weighted."""
    return weights[0] * fine + weights[1] * contain + weights[2] * rare


def shared_ngrams(down: DataFrame, up: DataFrame, statistics: DataFrame, n: int = 4) -> DataFrame:
    """[E2] Share of the downstream unit's weight of rare CJK n-grams that the upstream unit has: ``d``, ``u``, ``ngrams``.

    An n-gram counts as often as the rarest of its pairs of characters; one with an unknown pair counts as everywhere.
    """
    def grams(df: DataFrame, s: str) -> DataFrame:
        runs = F.regexp_extract_all(F.upper(T.normalised(F.col("content"))), F.lit(f"[{T.CJK}]{{{n},}}"), F.lit(0))
        cut = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n))))
        return df.select(F.col("uid").alias(s), F.explode(F.array_distinct(F.flatten(cut))).alias("gram"))

    own = grams(down, "d")
    pairs = own.select("gram").distinct().select("gram", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("i")).withColumn("token", F.substring("gram", F.col("i"), F.lit(2)))
    known = pairs.join(statistics.select("token", "df", "n"), "token", "left")
    rarest = known.groupBy("gram").agg(F.min("df").alias("df"), F.max("n").alias("n")).filter((F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") / 10))))
    weighed = own.join(rarest.select("gram", (F.log(F.col("n") / F.col("df")) + 1).alias("w")), "gram")
    total = weighed.groupBy("d").agg(F.sum("w").alias("total"))
    return weighed.join(grams(up, "u"), "gram").groupBy("d", "u").agg(F.sum("w").alias("w")).join(total, "d").select("d", "u", (F.col("w") / F.col("total")).alias("ngrams"))


def anchored(pairs: DataFrame, weight: float, o: DiscoveryOptions = DiscoveryOptions()) -> DataFrame:
    """[E3] The fused score with the anchors' level added at a weight, without a gate, at most 1."""
    return pairs.withColumn("score", F.least(F.lit(1.0), F.col("score") + weight * V.anchor_level(F.col("anchor"), o)))


def decision_grid(scored: DataFrame, down: DataFrame, graph: DataFrame, gold: DataFrame, options: dict[str, DiscoveryOptions]) -> DataFrame:
    """[E3, E4] Folded decisions under several options against gold relations: found, gold, hits, precision, recall and F1 of each."""
    from functools import reduce

    from spanloom.operators import compare

    rows = []
    for name, o in options.items():
        decisions = discovery.decided(discovery.folded(scored, graph, o), down, o)
        found = decisions.select("d", F.explode("relations").alias("r")).select("d", "r.u")
        rows.append(compare.decision_metrics(found, gold, decisions.select("d", "status")).withColumn("options", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)

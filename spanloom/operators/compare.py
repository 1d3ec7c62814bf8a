"""Comparison with a baseline, and quality metrics against known relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_diff(base: DataFrame, result: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """[J17, J20] Cells of two sheets side by side: keys, both values and ``kind`` (same, changed, missing, extra)."""
    both = base.select(*keys, F.col(value).alias("base")).withColumn("_b", F.lit(True)).join(result.select(*keys, F.col(value).alias("result")).withColumn("_r", F.lit(True)), keys, "full_outer")
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("base").eqNullSafe(F.col("result")), "same").otherwise("changed")
    return both.select(*keys, "base", "result", kind.alias("kind"))


def colour_distance(base: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """[A14] Euclidean distance of the shares of the three classes, and how serious it is.

    Both sides have ``g``, ``b``, ``k``, the characters of each class.
    """
    shares = lambda df, p: df.select(*keys, *(F.when(F.col("g") + F.col("b") + F.col("k") > 0, F.col(c) / (F.col("g") + F.col("b") + F.col("k"))).otherwise(0.0).alias(f"{p}{c}") for c in "gbk"))
    both = shares(base, "x").join(shares(result, "y"), keys, "full_outer").na.fill(0.0)
    gap = lambda c: (F.col(f"x{c}") - F.col(f"y{c}")) * (F.col(f"x{c}") - F.col(f"y{c}"))
    d = F.sqrt(gap("g") + gap("b") + gap("k"))
    level = F.when(F.col("distance") > 0.30, "large").when(F.col("distance") > 0.15, "medium").when(F.col("distance") > 0.05, "small").otherwise("none")
    return both.withColumn("distance", d).withColumn("level", level)


def mismatch_segments(characters: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """[A14, W5] Stretches of differing characters, joined over gaps of up to ``gap``: keys, ``start``, ``end``, ``mismatches``.

    ``characters`` has ``pos``, ``base`` and ``result``.
    """
    bad = characters.filter(~F.col("base").eqNullSafe(F.col("result")))
    order = Window.partitionBy(*keys).orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(order) > gap + 1, F.lit(True))
    return bad.withColumn("segment", F.sum(fresh.cast("int")).over(order)).groupBy(*keys, "segment").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("mismatches"))


def diff_kind(base: Column, result: Column) -> Column:
    """[A14] How a class changed."""
    return F.when(base.isNull(), "new").when(result.isNull(), "lost").when(base == result, "same").otherwise(F.concat(F.lower(base), F.lit("_to_"), F.lower(result)))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """[A15] Hits within k and mean reciprocal rank; ``ranked`` has ``d``, ``u``, ``rank``, ``gold`` has ``d``, ``u``.

    Each gold relation counts once; one that is not ranked has no reciprocal.
    """
    best = gold.select("d", "u").distinct().join(ranked.select("d", "u", "rank"), ["d", "u"], "left").groupBy("d", "u").agg(F.min("rank").alias("rank"))
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    return best.agg(F.count("*").alias("relations"), *hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def recall_by_channel(pairs: DataFrame, gold: DataFrame, channels: list[str], k: int) -> DataFrame:
    """[A17] Share of gold relations among the best k of each channel, and of any of them."""
    ranked = pairs.withColumns({f"_{c}": F.row_number().over(Window.partitionBy("d").orderBy(F.desc(c), "u")) <= k for c in channels})
    found = gold.select("d", "u").distinct().join(ranked, ["d", "u"], "left")
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    anyone = F.greatest(*(F.coalesce(F.col(f"_{c}"), F.lit(False)) for c in channels)) if len(channels) > 1 else F.col(f"_{channels[0]}")
    return found.agg(F.count("*").alias("relations"), *(share(F.col(f"_{c}")).alias(f"recall_{c}") for c in channels), share(anyone).alias("recall_union"))


def decision_metrics(found: DataFrame, gold: DataFrame, decided: DataFrame) -> DataFrame:
    """[A16] Precision, recall, F1, and units with gold relations that were left untraced.

    ``found`` and ``gold`` hold pairs ``d``, ``u``; ``decided`` has ``d`` and ``status``.
    """
    f, g = found.select("d", "u").distinct(), gold.select("d", "u").distinct()
    counts = f.agg(F.count("*").alias("found")).crossJoin(g.agg(F.count("*").alias("gold"))).crossJoin(f.join(g, ["d", "u"], "left_semi").agg(F.count("*").alias("hits")))
    lost = decided.filter("status = 'untraced'").join(g.select("d").distinct(), "d", "left_semi").agg(F.count("*").alias("false_untraced"))
    out = counts.crossJoin(lost)  # single rows
    p, r = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0), F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weight_grid(pairs: DataFrame, gold: DataFrame, weights: DataFrame, channels: list[str]) -> DataFrame:
    """[A18] Quality of each row of weights in one pass: hits at 1, 3, 5, and the key 3·t1 + 2·t3 + t5.

    ``weights`` has ``grid`` and a column ``w_<channel>`` each; it is small and broadcast.
    """
    score = sum((F.col(c) * F.col(f"w_{c}") for c in channels), F.lit(0.0))
    ranked = pairs.crossJoin(F.broadcast(weights)).withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("grid", "d").orderBy(F.desc("score"), "u")))
    best = ranked.join(gold.select("d", "u").distinct(), ["d", "u"], "left_semi")
    total = gold.select("d", "u").distinct().agg(F.count("*").alias("relations"))
    t = {f"t{k}": F.count_if(F.col("rank") <= k) for k in (1, 3, 5)}
    out = best.groupBy("grid").agg(*(v.alias(k) for k, v in t.items())).crossJoin(F.broadcast(total))
    return out.withColumn("key", 3 * F.col("t1") + 2 * F.col("t3") + F.col("t5"))

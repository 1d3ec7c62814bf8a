"""Homomorphic multiset fingerprints of documents, in Spark expressions only.

A paragraph hashes to a wide vector, a document's fingerprint is the sum of its paragraphs' vectors
modulo 2**32. So the order of paragraphs does not count, and a paragraph is inserted or deleted by
adding or subtracting its vector. The lanes are:

* ``EQUALITY`` lanes, halves of salted 64-bit hashes of the paragraph: equal sums mean equal
  multisets, but for chance;
* a lane that counts elements, the pairs of neighbouring words of the paragraph, its ends included;
* ``SKETCH`` lanes, where an element adds one of its hash's bits. As a lane minus half the count it is
  a random signed sum, so products of lanes estimate how many elements two documents share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise
from spanloom.llm.graph import few_files

EQUALITY = 16
SKETCH = 64
MODULUS = 1 << 32
_LOW = MODULUS - 1
#: Bits k and k + 32 of an element's hash go to one sum: lanes that 2**31 elements cannot make overflow.
_PAIR = (1 << 32) | 1


def _words(text: Column) -> Column:
    """Words parted by spaces, and a line feed as a word of its own before, between and after paragraphs."""
    return F.split(F.concat(F.lit("\n "), F.replace(text, F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " ", -1)


def _sum_of(hashes: Column, half: Callable[[Column], Column]) -> Column:
    low = F.lit(_LOW)
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: (total + half(h).bitwiseAND(low)).bitwiseAND(low))


def _salted(paragraphs: Column, salt: int) -> Column:
    return F.transform(paragraphs, lambda p: F.xxhash64(F.lit(salt), p))


def _equality_lanes(paragraphs: Column) -> list[Column]:
    hashes = [_salted(paragraphs, salt) for salt in range(EQUALITY // 2)]
    return [_sum_of(h, half) for h in hashes for half in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x)]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``lanes`` (array of longs) for each row; ``keys`` must tell all rows apart.

    If ``texts`` is already partitioned by some of ``keys``, as after a join on them, nothing is shuffled.
    """
    split = texts.select(*keys, _words(F.col(text)).alias("words"), F.split(F.col(text), "\n", -1).alias("paragraphs"))
    split = split.select(*keys, "words", *(lane.alias(f"q{i}") for i, lane in enumerate(_equality_lanes(F.col("paragraphs")))))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(a, b))
    hashed = split.select(*keys, *(f"q{i}" for i in range(EQUALITY)), pairs.alias("pairs"))
    elements = hashed.select(*keys, *(f"q{i}" for i in range(EQUALITY)), F.explode("pairs").alias("h"))
    sums = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(_PAIR))).alias(f"s{k}") for k in range(32)]
    found = elements.groupBy(*keys).agg(*(F.max(f"q{i}").alias(f"q{i}") for i in range(EQUALITY)), F.count("*").alias("n"), *sums)
    low = [F.col(f"s{k}").bitwiseAND(F.lit(_LOW)) for k in range(32)]
    high = [F.shiftrightunsigned(f"s{k}", 32) for k in range(32)]
    return found.select(*keys, F.array(*(f"q{i}" for i in range(EQUALITY)), F.pmod("n", F.lit(MODULUS)), *low, *high).alias("lanes"))


def inserted(lanes: Column, more: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.zip_with(lanes, more, lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def deleted(lanes: Column, less: Column) -> Column:
    """Fingerprint without the paragraphs of ``less``."""
    return F.zip_with(lanes, less, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def written(lanes: Column) -> Column:
    """Lanes as one lower-case hexadecimal string, eight digits each."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common elements, 0 to 1: products over squares of the signed sums; 1 if the equality lanes agree."""

    def signed(lanes: Column, i: int) -> Column:
        return (2 * lanes[EQUALITY + 1 + i] - lanes[EQUALITY]).cast("double")

    def total(x: Column, y: Column) -> Column:
        return reduce(lambda p, q: p + q, [signed(x, i) * signed(y, i) for i in range(SKETCH)])

    common, union = total(a, b), total(a, a) + total(b, b) - total(a, b)
    share = F.when(union > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), common / union))).otherwise(0.0)
    return F.when(F.slice(a, 1, EQUALITY) == F.slice(b, 1, EQUALITY), 1.0).otherwise(share)


def next_ids(ids: DataFrame, partitions: int) -> DataFrame:
    """``doc_id`` and ``next_id``, the next greater one and after the last the first.

    Only ids move: dealt by ranges, ordered within each, and tied across ranges by a row of each range.
    A file holds many ranges.
    """
    rows = ids.count()
    ranged = ids.repartitionByRange(partitions, "doc_id").withColumn("part", F.spark_partition_id())
    ranged = materialise(few_files(ranged, rows))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    by_part = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.min("first").over(Window.partitionBy())).alias("after"))
    inner = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    # at most a row for each of ``partitions`` ranges
    found = ranged.withColumn("inner", inner).join(F.broadcast(after), "part").select(*ids.columns, F.coalesce("inner", "after").alias("next_id"))
    return few_files(found, rows)


def _both_sides(rows: DataFrame) -> DataFrame:
    """Facts and lanes of each row's text (``own``) and of its edited form (``edited``, null without a ``head``)."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.when(F.col("head").isNotNull(), F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("head", F.lit(1), quarter)))
    sides = rows.select("doc_id", "row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))).alias("s"))
    facts = sides.select("doc_id", "row", "s.side", "s.text").filter(F.col("text").isNotNull()).select(
        "doc_id", "row", "side", "text", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("hash")
    )
    lanes = fingerprints(facts, ["doc_id", "row", "side", "n_chars", "sha", "hash"])
    return lanes.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("side") == 0, F.struct("n_chars", "hash", "lanes"))).alias("own"),
        F.max(F.when(F.col("side") == 1, F.struct("sha", "lanes"))).alias("edited"),
    )


def compare_edited(docs: DataFrame, *, partitions: int = 256) -> DataFrame:
    """Fingerprint each text, its edited form, and say how like it is to that and to the next text.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many,
    or all, of the text with the next greater ``doc_id``, after the last the first. Returns
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. A null text counts as empty. Rows of a repeated id each give a
    row; where the next id is repeated, the text of the least hash is the next one. A row without an
    id has no place in the order, so its edited form, and what compares with it, is null. Other
    columns are left out; an empty table gives an empty result.

    Texts are dealt by id once, for both the join that fetches what replaces the tail and the one
    that puts it in; only tails, ids and fingerprints are dealt besides.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both joins below read the same columns and rows of this table, so its texts are dealt out once
    base = whole.filter(F.col("doc_id").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4)).cast("int").alias("tail"))
    order = materialise(next_ids(ids, partitions))
    tie = F.struct(F.xxhash64("text"), F.col("row"))
    heads = base.join(order.select(F.col("doc_id").alias("id"), "next_id", "tail"), F.col("doc_id") == F.col("next_id")).select("id", F.substring("text", F.lit(1), F.col("tail")).alias("head"), tie.alias("tie"))
    heads = heads.groupBy("id").agg(F.min_by("head", "tie").alias("head"))
    both = base.join(heads, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "row", "head")
    unplaced = whole.filter(F.col("doc_id").isNull()).select("doc_id", "text", (-1 - F.monotonically_increasing_id()).alias("row"), F.lit(None).cast("string").alias("head"))
    # each by itself: the joined rows are grouped where they are
    one = _both_sides(both).unionByName(_both_sides(unplaced))
    one = materialise(one)
    following = one.groupBy("doc_id").agg(F.min_by("own.lanes", F.struct("own.hash", "row")).alias("next_lanes")).select(F.col("doc_id").alias("next_id"), "next_lanes")
    following = order.select(F.col("doc_id").alias("id"), "next_id").join(following, "next_id")
    return one.join(following, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id",
        F.col("own.n_chars").alias("n_chars"),
        F.col("edited.sha").alias("edited_sha256"),
        written(F.col("own.lanes")).alias("fingerprint"),
        written(F.col("edited.lanes")).alias("edited_fingerprint"),
        likeness(F.col("own.lanes"), F.col("edited.lanes")).alias("near_edited"),
        likeness(F.col("own.lanes"), F.col("next_lanes")).alias("near_next"),
    )

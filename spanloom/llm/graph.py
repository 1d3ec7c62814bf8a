"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, materialise

#: Rows of a few integers that go to one file, about 8 MB.
ROWS_PER_FILE = 500_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more partitions than they need, however many the session sets.

    In a mounted folder, Hadoop starts processes for each file, each a copy of its executor until
    its own program runs, so a table of many small files costs time, and memory for moments.
    """
    return df.coalesce(rows // ROWS_PER_FILE + 1)


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """One contraction: each node's neighbours are tied to the node's least neighbour.

    ``upward`` looks at all neighbours and ties the greater ones; else only at smaller ones, and ties
    those and the node itself. The minimum is aggregated before the shuffle, and the join that brings
    it back to the edges may be split, so a node with very many neighbours is no hot spot.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("low"))
    tied = both.join(least, both["a"] == least["centre"])
    if upward:
        low = F.least("low", "centre")
        pairs = tied.filter(F.col("b") > F.col("centre")).select(F.col("b").alias("a"), low.alias("b"))
    else:
        pairs = tied.select("b", "low").unionByName(least.select(F.col("centre").alias("b"), "low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pairs.filter("a <> b").distinct()


def connected_components(edges: DataFrame, left: str, right: str, *, most_rounds: int = 60) -> DataFrame:
    """Least node id of the component of every node that has an edge: ``node``, ``component``.

    ``edges`` holds pairs of non-null integers in any direction, repeated or not; loops don't count.
    Rounds of large-star and small-star contraction go on until nothing changes, which takes a number
    of rounds logarithmic in the nodes; each round's edges are written to shared storage, in as many
    files as the edges before it need. Only a count and a checksum reach the driver.
    """
    current = materialise(edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a <> b").distinct())

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    last, count = None, current.count()
    for _ in range(most_rounds):
        current, before = materialise(few_files(_stars(_stars(current, True), False), count)), current
        discard(before)
        if (now := state(current)) == last or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, count = now, now[0]
    raise RuntimeError("components did not settle")

"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of codewords, one of each of several full-dimensional codebooks, found by
beam search. A query's inner products with all codewords form a lookup table; a candidate's
approximate score is a sum of table entries. The best candidates are ranked again on the original
vectors in double precision. How far a vector lies from its code bounds what its score can be, so all
others that could be among the best are ranked, too, and none is missed however badly a vector is coded.
Codebooks are fitted on a bounded sample, every vector is indexed, and every query meets every index
row, in tasks that each hold a strip of codes and vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from spanloom.llm.common import hash_sample, map_columns, materialise, release_memory, resident, sample_fraction, small_batches

CODEBOOKS, CODEWORDS, BEAM = 32, 256, 4
#: Bound of the sample that codebooks are fitted on, and of the driver's share of work.
TRAIN_VECTORS = 10_000
#: Distinct vectors of each query that are ranked again before bounds are known.
SHORTLIST = 256
#: Codes, and bytes of vectors, that a task holds at once; queries that are worth a task of their own, and most that one task is given.
STRIP, STRIP_BYTES, QUERY_BLOCK, MOST_QUERIES = 1 << 20, 1 << 27, 512, 1 << 15
#: Tasks that the scan is split into before a task is given more than ``QUERY_BLOCK`` queries.
TASKS = 2000


@dataclass
class Codebooks:
    """``words`` has shape (codebooks, codewords, dimensions); ``norms`` their pairwise inner products."""

    words: np.ndarray

    def encode(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of shape (n, codebooks) and the squared norm of each coded vector.

        The beam keeps, for each vector, the partial sums nearest to it.
        """
        n = len(vectors)
        residual = vectors[:, None, :].astype("float32")
        codes = np.zeros((n, 1, 0), "uint8")
        for book in self.words:
            gain = 2 * residual @ book.T - (book**2).sum(axis=1)  # how much nearer each codeword comes
            error = (residual**2).sum(axis=2)[:, :, None] - gain
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            source, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, source], word[:, :, None].astype("uint8")], axis=2)
            residual = residual[rows, source] - book[word]
        first = (residual**2).sum(axis=2).argmin(axis=1)
        rows = np.arange(n)
        coded = vectors - residual[rows, first]
        return codes[rows, first], (coded**2).sum(axis=1).astype("float32")

    def misses(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far vectors lie from what their codes stand for, rounded up."""
        coded = sum(book[codes[:, m]].astype("float64") for m, book in enumerate(self.words))
        far = np.sqrt(((vectors - coded) ** 2).sum(axis=1)) * (1 + 1e-6)
        return np.nextafter(far.astype("float32"), np.float32(np.inf))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of shape (queries, codebooks, codewords)."""
        return np.einsum("qd,mkd->qmk", queries.astype("float32"), self.words, optimize=True)


def _means(vectors: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), k, replace=len(vectors) < k)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        totals = np.zeros((k, vectors.shape[1]), "float64")
        np.add.at(totals, own, vectors)
        centres[counts > 0] = (totals[counts > 0] / counts[counts > 0, None]).astype("float32")
    return centres


def fit(vectors: np.ndarray, books: int = CODEBOOKS, words: int = CODEWORDS, rounds: int = 6) -> Codebooks:
    """Codebooks of residuals, one after another; then each is fitted again to what the others leave."""
    rng = np.random.default_rng(11)
    vectors = vectors.astype("float32")
    residual, found = vectors.copy(), []
    for _ in range(books):
        book = _means(residual, min(words, max(1, len(residual))), rounds, rng)
        book = np.concatenate([book, np.zeros((words - len(book), book.shape[1]), "float32")])
        own = ((book**2).sum(axis=1) - 2 * residual @ book.T).argmin(axis=1)
        residual -= book[own]
        found.append(book)
    model = Codebooks(np.stack(found))
    codes, _ = model.encode(vectors, 4)
    left = vectors - sum(model.words[m][codes[:, m]] for m in range(books))
    for m in range(books):
        target = left + model.words[m][codes[:, m]]
        counts = np.bincount(codes[:, m], minlength=words)
        totals = np.zeros((words, vectors.shape[1]))
        np.add.at(totals, codes[:, m], target)
        model.words[m][counts > 0] = (totals[counts > 0] / counts[counts > 0, None]).astype("float32")
        left = target - model.words[m][codes[:, m]]
    return model


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, as floats, of rows that take part: no null, zero or non-finite vector."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(~bad & some).select("vec_id", F.transform(v, lambda x: (x + F.lit(0.0)).cast("double")).alias("v"))


def exact(query: np.ndarray, vectors: np.ndarray, measure: str) -> np.ndarray:
    """Scores of columns of ``vectors`` in double precision, summed in the order of the components."""
    total = np.zeros(vectors.shape[1])
    for x, row in zip(query, vectors, strict=True):
        total += x * row if measure == "inner" else -(x - row) * (x - row)
    return total


class Strip:
    """Codes and vectors that a task holds, and the best of them for a query."""

    def __init__(self, place: tuple = ()):
        self.place = place
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._whole: tuple[np.ndarray, ...] | None = None

    def add(self, rows: pa.RecordBatch, kind: str) -> None:
        cells = lambda name, of: np.frombuffer(b"".join(rows.column(name).to_pylist()), of).reshape(rows.num_rows, -1)
        self._parts.append((rows.column("vec_id").to_numpy(), rows.column("norm").to_numpy(), rows.column("miss").to_numpy(), cells("code", "uint8"), cells("raw", kind)))

    def _held(self) -> tuple[np.ndarray, ...]:
        if self._whole is None:
            ids, norms, misses, codes, vectors = (np.concatenate(part) for part in zip(*self._parts, strict=True))
            self._parts, self._whole = [], (ids, norms, misses, np.ascontiguousarray(codes.T), vectors)
        return self._whole

    def best(self, query: np.ndarray, table: np.ndarray, n: int, shortlist: int, measure: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``n`` best, ties to the smaller id.

        A code's score is a sum of entries of ``table``. The ``n``-th of the exact scores of the ``shortlist`` best
        codes is a floor; of the rest, all that could reach it by their distance from their code are scored, too.
        """
        if not (self._parts or self._whole):
            return np.empty(0, "int64"), np.empty(0)
        ids, norms, misses, codes, vectors = self._held()
        scored = lambda at: exact(query, vectors[at].T.astype("float64"), measure)
        if shortlist < len(ids):
            with np.errstate(all="ignore"):
                near = table[0][codes[0]]
                for m in range(1, len(codes)):
                    near += table[m][codes[m]]
                rank = 2 * near - norms if measure == "euclidean" else near
                at = np.argpartition(-rank, shortlist - 1)[:shortlist]
                floor = np.partition(scored(at), -n)[-n]
                length, most = np.sqrt((query**2).sum()), np.sqrt(np.float64(norms.max()))
                doubt = len(codes) * 2.0**-22 * np.abs(table).max(axis=1).sum(dtype="float64") + len(query) * 1e-12 * length * most
                if measure == "euclidean":
                    square = length**2 - rank - 2 * doubt - 2.0**-20 * (length + most) ** 2
                    highest = -(np.maximum(np.sqrt(np.maximum(square, 0)) - misses, 0) ** 2)
                else:
                    highest = near + length * misses + doubt
                at = np.flatnonzero(~(highest < floor))  # what has no bound could be anything
        else:
            at = np.arange(len(ids))
        score = scored(at)
        if n < len(at):
            some = np.flatnonzero(score >= np.partition(score, -n)[-n])
            at, score = at[some], score[some]
        first = np.lexsort((ids[at], -score))[:n]
        return ids[at][first], score[first]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, shortlist: int = SHORTLIST, train_vectors: int = TRAIN_VECTORS, measure: str = "inner") -> DataFrame:
    """The ``k`` rows of largest inner product with each query row, the query's own left out.

    With ``measure="euclidean"`` nearness is the negative squared distance instead; the stored norms
    serve its approximation.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, exactly as computed on the
    original vectors in double precision; ties go to the smaller ``vec_id``. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows without an id, nor vectors
    of another length than most have (of lengths that are as frequent, the greater). If an id
    is repeated, its row of the least vector stands for it. Equal
    vectors are coded once; of each such group the ``k + 1`` smallest ids can be in a result, so no
    other copies are ranked. Other columns are left out; an empty table gives an empty result.

    Codes and vectors are dealt to strips of about ``STRIP``, queries to chunks. A task gets a strip, holds
    it, and reads a chunk's queries one after another. ``shortlist`` sets how many of the best codes give the
    floor that bounds are held against, not the result: each query gives the ``k + 1`` best vectors a strip.
    """
    spark = vectors.sparkSession
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind = "float32" if isinstance(element, FloatType) else "float64"
    given = usable(vectors)
    width = given.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = materialise(given.filter(F.size("v") == width["width"]).groupBy("vec_id").agg(F.min("v").alias("v")))
    copies = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("copy") <= k + 1)
    copies = materialise(copies.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))))
    distinct = copies.filter(F.col("copy") == 1).select("vec_id", "v")
    total = distinct.count()
    sample = hash_sample(distinct, F.col("vec_id"), sample_fraction(total, train_vectors)).orderBy("vec_id").toArrow()
    fitted = np.array(sample["v"].to_pylist() or [distinct.first()["v"]], "float32")
    data = pickle.dumps(fit(fitted))
    model, label = spark.sparkContext.broadcast(data), ("neighbours", hashlib.sha256(data).hexdigest())

    def pack_codes(columns: dict[str, list]) -> dict[str, list]:
        books, vectors = resident(label, lambda: pickle.loads(model.value)), np.array(columns["v"], "float64")
        with np.errstate(all="ignore"):
            codes, norms = books.encode(vectors.astype("float32"))
            misses = books.misses(vectors, codes)
        return {"vec_id": columns["vec_id"], "code": [c.tobytes() for c in codes], "norm": norms, "miss": misses, "raw": [v.tobytes() for v in vectors.astype(kind)]}

    coded = map_columns(distinct, pack_codes, "vec_id long, code binary, norm float, miss float, raw binary", rows=4096)
    queries = rows.filter(is_query)
    n_queries = queries.count()
    strips = max(1, -(-total // max(1, min(STRIP, STRIP_BYTES // (width["width"] * np.dtype(kind).itemsize)))))
    chunks = max(1, min(-(-n_queries // QUERY_BLOCK), max(TASKS // strips, -(-n_queries // MOST_QUERIES))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    held = coded.select(F.pmod(F.xxhash64("vec_id"), F.lit(strips)).alias("strip"), every(chunks).alias("chunk"), F.lit(0).alias("kind"), "vec_id", "norm", "miss", "code", "raw", F.lit(None).cast("array<double>").alias("v"))
    asked = queries.select(every(strips).alias("strip"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).alias("chunk"), F.lit(1).alias("kind"), "vec_id", *(F.lit(None).cast(of).alias(name) for name, of in (("norm", "float"), ("miss", "float"), ("code", "binary"), ("raw", "binary"))), "v")
    met = held.unionByName(asked).repartition(strips * chunks, "strip", "chunk").sortWithinPartitions("strip", "chunk", "kind", "vec_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = resident(label, lambda: pickle.loads(model.value))
        strip = Strip()
        for batch in small_batches(batches, rows=4096):
            places = np.stack([batch.column(name).to_numpy() for name in ("strip", "chunk", "kind")], axis=1)
            for part in np.split(np.arange(len(places)), (np.diff(places, axis=0) != 0).any(axis=1).nonzero()[0] + 1):
                at, here = part[0], batch.slice(part[0], len(part))
                if tuple(places[at][:2]) != strip.place:
                    strip = Strip(tuple(places[at][:2]))
                if places[at][2] == 0:
                    strip.add(here, kind)
                    continue
                ids, vectors = here.column("vec_id").to_pylist(), here.column("v").to_pylist()
                for query_id, v in zip(ids, vectors, strict=True):
                    query = np.array(v, "float64")
                    with np.errstate(all="ignore"):
                        asked_table = books.tables(query[None])[0]
                    reps, scores = strip.best(query, asked_table, k + 1, max(shortlist, k) + 1, measure)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), query_id)), pa.array(reps), pa.array(scores)], names=["query_id", "rep", "near"])
        release_memory()

    found = met.mapInArrow(scan, "query_id long, rep long, near double")
    if strips > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "rep")
        found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")
    named = found.select("query_id", "rep").join(copies.select("rep", "vec_id", F.col("v").alias("candidate")), "rep").filter("vec_id <> query_id")
    both = named.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")), "query_id")
    term = (lambda a, b: -(a - b) * (a - b)) if measure == "euclidean" else (lambda a, b: a * b)
    scored = both.select("query_id", "vec_id", F.aggregate(F.zip_with("query", "candidate", term), F.lit(0.0), lambda total, x: total + x).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of hashed byte bigrams and trigrams of its lower-cased words, of unit
length; signs, digits and layout do not count. Each language has a few centroids, found by spherical k-means on a bounded sample of its
rows. The centroid of the largest cosine decides; a text much farther from it than the training
texts were is rejected.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import hand_back_memory, held_out, map_columns, release_memory, resident, sample_fraction, small_batches

DIMENSIONS = 8192
CENTROIDS = 4
#: Bound of the training sample: rows of each language, and of all languages together.
ROWS_PER_LANGUAGE, ROWS_IN_ALL = 800, 16_000
UNDETERMINED = "und"
#: A text is rejected if its cosine is below this share of the cosine that 99 % of training texts reach.
REJECT_SHARE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed gram occurs in the whole text."""
    data = np.frombuffer(f" {_GAPS.sub(' ', text.lower())} ".encode("utf-8", "replace"), "uint8").astype("uint32")
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:]
    hashed = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(19)
    return np.bincount(hashed, minlength=DIMENSIONS)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    least: np.ndarray  # cosine that a text needs, by centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts, dtype="float32") * self.idf
        norm = np.linalg.norm(weighted, axis=-1, keepdims=True)
        return weighted / np.where(norm > 0, norm, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is rejected."""
        languages, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        told = [i for i, text in enumerate(texts) if text and _LETTER.search(text)]
        if told and self.languages:
            near = self.vectors(np.stack([gram_counts(texts[i]) for i in told])) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, k, cosine in zip(told, best.tolist(), near.max(axis=1).tolist(), strict=True):
                languages[i], scores[i] = self.languages[k], min(1.0, max(0.0, cosine))
                rejected[i] = cosine < self.least[k]
        return languages, scores, rejected


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the centroid of each row; the first seeds lie far from each other."""
    seeds = [0]
    nearest = vectors @ vectors[0]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds].copy()
    own = np.zeros(len(vectors), "int64")
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        for j in range(len(centroids)):
            if (own == j).any():
                total = vectors[own == j].sum(axis=0)
                centroids[j] = total / (np.linalg.norm(total) or 1)
    return centroids, own


def train(docs: DataFrame, *, centroids: int = CENTROIDS, rows_per_language: int = ROWS_PER_LANGUAGE, rows_in_all: int = ROWS_IN_ALL) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of rows that are not held out, with a language and a text.

    The sample is bounded by ``rows_per_language`` and ``rows_in_all``; what reaches the driver of a
    row is at most ``DIMENSIONS`` counts, however long its text is. Rows without a letter are left out.
    """
    usable = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    totals = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows_in_all).collect()}
    bound = max(1, min(rows_per_language, rows_in_all // max(1, len(totals))))
    share = {lang: sample_fraction(total, bound) for lang, total in totals.items()}
    if not share:
        return LanguageModel(np.ones(DIMENSIONS, "float32"), np.zeros((0, DIMENSIONS), "float32"), [], np.zeros(0))
    fraction = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    key = F.concat_ws(":", "doc_id", F.length("text"))
    sampled = usable.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < fraction * (1 << 30)))

    def count(columns: dict[str, list]) -> dict[str, list]:
        told = [(lang, gram_counts(text)) for lang, text in zip(columns["lang"], columns["text"], strict=True) if _LETTER.search(text)]
        grams = [counts.nonzero()[0] for _, counts in told]
        return {"lang": [lang for lang, _ in told], "grams": grams, "counts": [counts[g] for g, (_, counts) in zip(grams, told, strict=True)]}

    found = map_columns(sampled, count, "lang string, grams array<smallint>, counts array<int>").toArrow()
    rows: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    document_frequency = np.zeros(DIMENSIONS)
    languages = found["lang"].to_pylist()
    sparse_rows = [tuple(found[name][i].values.to_numpy() for name in ("grams", "counts")) for i in range(len(languages))]
    for i in sorted(range(len(languages)), key=lambda i: (languages[i], *(part.tobytes() for part in sparse_rows[i]))):
        grams, counts = sparse_rows[i]
        document_frequency[grams] += 1
        rows.setdefault(languages[i], []).append((grams, counts))
    idf = (np.log((1 + len(languages)) / (1 + document_frequency)) + 1).astype("float32")
    model = LanguageModel(idf, np.zeros((0, DIMENSIONS), "float32"), [], np.zeros(0))
    for lang, sparse in rows.items():
        dense = np.zeros((len(sparse), DIMENSIONS), "float32")
        for row, (grams, counts) in zip(dense, sparse, strict=True):
            row[grams] = counts
        vectors = model.vectors(dense)
        means, own = spherical_means(vectors, centroids)
        cosine = (vectors * means[own]).sum(axis=1)
        model.centroids = np.concatenate([model.centroids, means])
        model.languages += [lang] * len(means)
        model.least = np.concatenate([model.least, np.full(len(means), REJECT_SHARE * np.quantile(cosine, 0.01))])
    del found, rows, sparse_rows
    hand_back_memory()
    return model


def _shared(docs: DataFrame, model: LanguageModel) -> tuple:
    """The model as a broadcast value, and a name for it."""
    data = pickle.dumps(model)
    return docs.sparkSession.sparkContext.broadcast(data), ("languages", hashlib.sha256(data).hexdigest())


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Predict each row's language from its whole text alone, without a shuffle.

    Returns ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the cosine) and ``rejected``. A null
    text, or one without a letter, is ``und`` with score 0 and rejected, and so is everything if
    nothing could be learned. Each row gives a row, whether ids are null or repeated; other columns
    are left out. Ties go to the first language in order. The model (under 4 MB for a few dozen
    languages) is broadcast; its size is bounded by the training sample.
    """
    shared, name = _shared(docs, model)

    def predict(columns: dict[str, list]) -> dict[str, list]:
        languages, scores, rejected = resident(name, lambda: pickle.loads(shared.value)).predict(columns["text"])
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": languages, "score": scores, "rejected": rejected}

    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return map_columns(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), predict, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text the model does not reject.

    A null text, or one without a letter, goes. Rows of null or repeated ids are judged like others,
    each by itself; an empty table stays empty.
    """
    shared, name = _shared(docs, model)

    def keep(batches):
        found = resident(name, lambda: pickle.loads(shared.value))
        for part in small_batches(batches):
            _, _, rejected = found.predict(part.column("text").to_pylist())
            yield part.filter(np.logical_not(rejected).tolist())
        release_memory()

    return docs.mapInArrow(keep, docs.schema)

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, a field needs labels of tokens. Cues are words and beginnings of words that
hardly occur in clean documents; they are chosen greedily so that together they explain the toxic
ones, which leaves out words that only came along in copies. A token that has a cue, in a toxic
document, is labelled toxic. The field then learns weights of words, their beginnings, endings and
lengths, and of the transitions, from these tokens. Forward-backward gives each token's marginal.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import RecentCache, hand_back_memory, hash_sample, held_out, map_columns, release_memory, resident, sample_fraction, small_batches

#: Bounds of the training sample: toxic and clean documents, and characters of each of them.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARACTERS = 800, 1200, 20_000
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5

_BUCKETS = 1 << 18
_SEGMENT = 32
_EDGES = ".,;:!?|()[]{}\"'`*#$%&<>«»„“”…-_/\\"
_WORD = re.compile(r"\S+")


def normal(token: str) -> str:
    """A lower-cased token without the signs around it."""
    return token.strip(_EDGES)


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def cues_of(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return [word, *(word[:n] + "~" for n in (3, 4, 5, 6) if len(word) > n)]


def features_of(word: str) -> list[int]:
    """Hashed features of a token for the field."""
    names = [f"w={word}", f"l={min(len(word), 12)}", *(f"p={word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), *(f"s={word[-n:]}" for n in (3, 4) if len(word) >= n)]
    return [zlib.crc32(name.encode("utf-8", "replace")) % _BUCKETS for name in names]


def choose_cues(toxic: list[set[str]], clean: list[set[str]], least_support: int = 3, least_gain: int = 2, noise: float = 0.02) -> set[str]:
    """Cues that clean documents hardly have and that, chosen in turn, each explain most of the toxic documents left."""
    numbers: dict[str, int] = {}
    for words in toxic:
        for word in words:
            for cue in cues_of(word):
                numbers.setdefault(cue, len(numbers))
    present = [np.array(sorted({numbers[cue] for word in words for cue in cues_of(word)}), "int32") for words in toxic]
    times, against = np.zeros(len(numbers), "int32"), np.zeros(len(numbers), "int32")
    for cues in present:
        times[cues] += 1
    for words in clean:
        against[list({numbers[cue] for word in words for cue in cues_of(word) if cue in numbers})] += 1
    good = (times >= least_support) & (against <= noise * times)
    where: dict[int, set[int]] = defaultdict(set)
    for i, cues in enumerate(present):
        for cue in cues[good[cues]].tolist():
            where[cue].add(i)
    names = {number: cue for cue, number in numbers.items() if good[number]}
    docs_of = {names[number]: docs for number, docs in where.items()}
    never = {names[number] for number in where if not against[number]}
    open_cues, chosen, left = dict(docs_of), set(), set(range(len(toxic)))
    while open_cues:
        gains = {cue: len(docs & left) for cue, docs in open_cues.items()}
        open_cues = {cue: open_cues[cue] for cue, gain in gains.items() if gain >= least_gain}
        if not open_cues:
            break
        best = max(open_cues, key=lambda cue: (gains[cue], len(cue), cue))
        chosen.add(best)
        left -= open_cues.pop(best)
    # the greedy choice stops once all is explained; other cues as good as those count as well, but of
    # beginnings that stand for the same documents only the longest
    usual = np.median([len(docs_of[cue]) for cue in chosen]) if chosen else 0
    for cue in sorted((cue for cue in never if chosen and len(docs_of[cue]) >= max(least_support, 0.2 * usual)), key=lambda cue: (-len(cue), cue)):
        stem = cue.rstrip("~")
        if not any(other.startswith(stem) and len(docs_of[cue]) <= 1.1 * len(docs_of[other]) for other in chosen):
            chosen.add(cue)
    return chosen


@dataclass
class ToxicityModel:
    """Emission weights of label 1 by hashed feature; ``transition`` holds 0→1, 1→0, 1→1, and 0→0 is nothing."""

    weights: list[float]
    bias: float = -20.0
    start: float = 0.0
    transition: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._seen = RecentCache(self._odds)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_seen"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def _odds(self, token: str) -> float:
        word = normal(token)
        score = self.bias + (sum(map(self.weights.__getitem__, features_of(word))) if word else 0.0)
        return math.exp(min(40.0, max(-40.0, score)))

    def marginals(self, tokens: list[str]) -> list[float]:
        """Probability of each token's being toxic, given all tokens of the text."""
        seen = self._seen
        seen.room()
        odds = list(map(seen.__getitem__, tokens))
        a01, a10, a11 = np.exp(self.transition).tolist()
        forward, ratio = [], float(np.exp(self.start))
        first = True
        for e in odds:
            ratio = e * (ratio if first else (a01 + a11 * ratio) / (1 + a10 * ratio))
            first = False
            forward.append(ratio)
        out, back = [0.0] * len(odds), 1.0
        for t in range(len(odds) - 1, -1, -1):
            joint = forward[t] * back
            out[t] = joint / (1 + joint)
            step = odds[t] * back
            back = (a10 + a11 * step) / (1 + a01 * step)
        return out

    def score(self, marginals: list[float]) -> float:
        """One minus the chance that no stretch of likely tokens is toxic; without any, half the highest marginal."""
        clean, peak, likely = 1.0, 0.0, False
        for p in [*marginals, 0.0]:
            if p >= SPAN_MARGINAL:
                likely, peak = True, max(peak, p)
            elif peak:
                clean, peak = clean * (1 - peak), 0.0
        return min(1.0, 1 - clean) if likely else 0.5 * max(marginals, default=0.0)


def fit_field(sequences: list[tuple[list[str], list[int]]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4) -> ToxicityModel:
    """Maximum likelihood by full gradients; tokens are cut into short chains, and all chains are stepped together."""
    kinds: dict[str, int] = {}
    segments = []
    for words, labels in sequences:
        for at in range(0, len(words), _SEGMENT):
            segments.append(([kinds.setdefault(w, len(kinds)) for w in words[at : at + _SEGMENT]], labels[at : at + _SEGMENT]))
    model = ToxicityModel([0.0] * _BUCKETS)
    if not any(any(labels) for _, labels in segments):
        return model
    shape = (_SEGMENT, len(segments))
    word, gold, live = np.zeros(shape, "int32"), np.zeros(shape, "float32"), np.zeros(shape, bool)
    for j, (ids, labels) in enumerate(segments):
        word[: len(ids), j], gold[: len(ids), j], live[: len(ids), j] = ids, labels, True
    listed, counts = array("i"), array("i")
    for w in kinds:
        found = features_of(w)
        listed.extend(found)
        counts.append(len(found))
    owner = np.repeat(np.arange(len(kinds), dtype="int32"), np.asarray(counts))
    used, slot = np.unique(np.asarray(listed), return_inverse=True)
    # parameters: features, bias, start, transitions 0->1, 1->0, 1->1
    theta = np.zeros(len(used) + 5)
    theta[-5] = -3.0
    squares = np.full_like(theta, 1e-8)
    pairs = live[1:]
    positive = max(1.0, gold.sum())
    for _ in range(rounds):
        emission = np.bincount(owner, weights=theta[:-5][slot], minlength=len(kinds))[word] + theta[-5]
        odds = np.where(live, np.exp(np.clip(emission, -40, 40)), 1.0)
        a01, a10, a11 = np.exp(theta[-3:])
        forward, back = np.empty(shape), np.ones(shape)
        forward[0] = odds[0] * np.exp(theta[-4])
        for t in range(1, _SEGMENT):
            forward[t] = odds[t] * (a01 + a11 * forward[t - 1]) / (1 + a10 * forward[t - 1])
        for t in range(_SEGMENT - 2, -1, -1):
            step = odds[t + 1] * back[t + 1]
            back[t] = np.where(live[t + 1], (a10 + a11 * step) / (1 + a01 * step), 1.0)
        joint = forward * back
        marginal = np.where(live, joint / (1 + joint), 0.0)
        # pairs of neighbours
        left, right = forward[:-1], odds[1:] * back[1:]
        total = 1 + a01 * right + a10 * left + a11 * left * right
        both = np.array([((x / total) * pairs).sum() for x in (a01 * right, a10 * left, a11 * left * right)])
        seen = np.array([(g * pairs).sum() for g in ((1 - gold[:-1]) * gold[1:], gold[:-1] * (1 - gold[1:]), gold[:-1] * gold[1:])])
        missed = np.where(live, gold - marginal, 0.0)
        by_word = np.bincount(word.ravel(), weights=missed.ravel(), minlength=len(kinds))
        gradient = np.concatenate([np.bincount(slot, weights=by_word[owner], minlength=len(used)), [missed.sum(), missed[0].sum()], seen - both])
        gradient = gradient / positive - decay * theta
        squares += gradient**2
        theta += rate * gradient / np.sqrt(squares)
    for k, weight in zip(used.tolist(), theta[:-5].tolist(), strict=True):
        model.weights[k] = weight
    model.bias, model.start, model.transition = float(theta[-5]), float(theta[-4]), tuple(theta[-3:].tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, train_characters: int = TRAIN_CHARACTERS) -> ToxicityModel:
    """Learn from the labelled rows that are not held out.

    The sample holds about ``toxic_rows`` and ``clean_rows`` documents of at most
    ``train_characters``, so what the driver receives has a bound. Rows with a null text, id or label
    are left out; a document labelled more than once counts as toxic if any label says so. Without
    toxic rows the model calls everything clean.
    """
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {row["toxic"]: row["count"] for row in told.groupBy("toxic").count().filter(F.col("toxic").isin(0, 1)).collect()}
    parts = [hash_sample(told.filter(F.col("toxic") == value), F.col("doc_id"), sample_fraction(totals.get(value, 0), bound)) for value, bound in ((1, toxic_rows), (0, clean_rows))]
    chosen = parts[0].unionByName(parts[1])  # two numbers for each row of a bounded sample
    sampled = docs.select("doc_id", "text").filter(F.length("text") <= train_characters).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    found = sorted({(row["toxic"], row["text"]) for row in sampled.collect()})
    one: dict[str, str] = {}  # one object for each word
    toxic, clean = ([[one.setdefault(w := normal(t), w) for t in tokens_of(text)] for value, text in found if value == kind] for kind in (1, 0))
    del found
    cues = choose_cues([set(words) - {""} for words in toxic], [set(words) - {""} for words in clean])
    known: dict[str, int] = {}
    for words in toxic:
        for word in words:
            if word not in known:
                known[word] = int(bool(word) and not cues.isdisjoint(cues_of(word)))
    model = fit_field([(words, [known[w] for w in words]) for words in toxic] + [(words, [0] * len(words)) for words in clean])
    del toxic, clean, known, cues, one
    hand_back_memory()
    return model


def toxic_spans(text: str, marginals: list[float]) -> list[tuple[int, int]]:
    """Stretches of likely toxic tokens, in code points."""
    out: list[tuple[int, int]] = []
    inside = False
    for m, p in zip(_WORD.finditer(text), marginals, strict=False):
        if p >= SPAN_MARGINAL:
            out = [*out[:-1], (out[-1][0], m.end())] if inside else [*out, m.span()]
        inside = p >= SPAN_MARGINAL
    return out


def _shared(docs: DataFrame, model: ToxicityModel) -> tuple:
    """The model as a broadcast value, and a name for it."""
    data = pickle.dumps(model)
    return docs.sparkSession.sparkContext.broadcast(data), ("toxicity", hashlib.sha256(data).hexdigest())


def score_documents(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """Score each row's whole text, without a shuffle.

    Returns ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on) and ``spans``
    (``start:end`` of offending stretches in code points, joined by commas). A null or empty text
    scores 0. Each row gives a row, whether ids are null or repeated; other columns are left out. The
    model (about 1 MB, of fixed size) is broadcast.
    """
    shared, name = _shared(docs, model)

    def score(columns: dict[str, list]) -> dict[str, list]:
        found = resident(name, lambda: pickle.loads(shared.value))
        scores, spans = [], []
        for text in columns["text"]:
            marginals = found.marginals(tokens_of(text)) if text else []
            scores.append(found.score(marginals))
            spans.append(",".join(f"{a}:{b}" for a, b in toxic_spans(text, marginals)) if max(marginals, default=0) >= SPAN_MARGINAL else "")
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores], "spans": spans}

    schema = "doc_id long, held_out boolean, score double, predicted int, spans string"
    return map_columns(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), score, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score below ``threshold``.

    A null or empty text scores 0 and stays. Rows of null or repeated ids are judged like others, each
    by itself; an empty table stays empty.
    """
    shared, name = _shared(docs, model)

    def keep(batches):
        found = resident(name, lambda: pickle.loads(shared.value))
        for part in small_batches(batches):
            yield part.filter([not text or found.score(found.marginals(tokens_of(text))) < threshold for text in part.column("text").to_pylist()])
        release_memory()

    return docs.mapInArrow(keep, docs.schema)

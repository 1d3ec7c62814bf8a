"""Pair verification: two texts, phrase by phrase, coloured GREEN (exact), BLUE (semantic) or BLACK.

Phrase work needs positions and dynamic programming, so a pair is verified in plain Python inside
one Arrow-fed step; encoders and entailment models are arguments, called once per batch of distinct
phrases. :func:`classified` is the same decision chain as one expression, for scores already known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.discovery import Encoder, hashed_grams
from spanloom.options import PRIORITY, MatchOptions

#: Entailment model: pairs of texts to (entailment, neutral, contradiction).
Entailment = Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]
GREEN, BLUE, BLACK = "GREEN", "BLUE", "BLACK"

_WIDTH = str.maketrans(T.FULL_WIDTH, T.HALF_WIDTH)
# What is taken for look-alikes, list marks and numbers.
_FIXES = [(re.compile(p), "1") for p in (r"(?<=[A-Z])l(?=[A-Z\d])", r"(?<=[A-Z])l$", r"(?<=\d)l(?=[A-Z])")] + [(re.compile(r"(?<=\d)[Oo](?=\d)"), "0")]
_MARK = re.compile(r"(?m)^\s*[-•●·]\s*")
_NUMBER = re.compile(r"(?m)^\s*(?:\d+[)）]|[a-zA-Z][)）])")
_LIST_START = re.compile(r"\s*(?:[-•●·]|\d+[)）]|[a-zA-Z][)）])")


def undecided(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
    """The default entailment model: no opinion."""
    return [(0.0, 0.0, 0.0)] * len(pairs)


@lru_cache(maxsize=100_000)
def normal(text: str) -> str:
    """What :func:`spanloom.functions.text.normalised` computes, for use inside Python."""
    t = text.strip().translate(_WIDTH)
    for sign, letters in T.ROMAN.items():
        t = t.replace(sign, letters)
    t = re.sub(T.PRIVATE_USE, "", t)
    t = re.sub(r"\s+", "", _NUMBER.sub("", _MARK.sub("", t)))
    t = re.sub(rf"(?:{T.FUNCTION_WORDS})$", "", re.sub(r"[；;。，,：:!?]+$", "", t))
    for pattern, sign in _FIXES:
        t = pattern.sub(sign, t)
    return t


def purify(phrase: str) -> str:
    t = re.sub(r"^\s*(?:\d+[)）]|[a-zA-Z][)）]|[-•●·]\s*)", "", phrase.strip()).strip()
    t = re.sub(r"[；;。，,\s]+$", "", t)
    if len(t) > 10 and len(shorter := re.sub(rf"(?:{T.FUNCTION_WORDS})[；;。，,：:\s]*$", "", t).strip()) >= 3:
        t = shorter
    return t or phrase.strip()


def set_jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def charset_likeness(a: str, b: str) -> float:
    x, y = normal(a), normal(b)
    return 0.0 if not x or not y else 1.0 if x == y else set_jaccard(set(x), set(y))


def bigram_likeness(a: str, b: str) -> float:
    x, y = normal(a), normal(b)
    pairs = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))}
    return 0.0 if not x or not y else 1.0 if x == y else set_jaccard(pairs(x), pairs(y))


def lcs_ratio(a: str, b: str, cap: int = 200) -> float:
    """[N5] Longest common subsequence of the normal forms over the longer length; both are cut if either exceeds the cap."""
    x, y = normal(a), normal(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if len(x) > cap or len(y) > cap:
        x, y = x[:cap], y[:cap]
    row = np.zeros(len(y) + 1, "int32")
    codes = np.array(list(y))
    for ch in x:
        best = np.maximum(row[1:], row[:-1] + (codes == ch))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1]) / max(len(x), len(y))


def assign(similarity: np.ndarray, floor: float = 0.5) -> list[tuple[int, int]]:
    """[A9] Pairs of rows and columns of the largest total similarity, one to one, by shortest augmenting paths.

    Similarities below the floor cost as much as 100 and are left out of the result.
    """
    if not similarity.size:
        return []
    cost = np.where(similarity >= floor, 1 - similarity, 100.0)
    turned = cost.shape[0] > cost.shape[1]
    if turned:
        cost = cost.T
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        match[m] = i
        slack, way, used, j = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool), m
        while match[j] != -1:
            used[j] = True
            free = ~used[:m]
            reduced = cost[match[j]] - u[match[j]] - v[:m]
            better = free & (reduced < slack)
            slack[better], way[better] = reduced[better], j
            k = int(np.where(free, slack, np.inf).argmin())
            step = slack[k]
            u[match[used]] += step
            v[used] -= step
            slack[free] -= step
            j = k
        while j != m:
            match[j] = match[way[j]]
            j = int(way[j])
    found = [(int(match[j]), j) for j in range(m) if match[j] != -1]
    return sorted((j, i) if turned else (i, j) for i, j in found if (similarity[j, i] if turned else similarity[i, j]) >= floor)


def assign_greedily(similarity: np.ndarray, floor: float = 0.5) -> list[tuple[int, int]]:
    """[A9] The same by taking the most similar free pair first."""
    out, rows, columns = [], set(), set()
    for _, i, j in sorted(((similarity[i, j], i, j) for i, j in zip(*np.where(similarity >= floor), strict=True)), reverse=True):
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((int(i), int(j)))
    return sorted(out)


@dataclass
class Phrase:
    text: str
    start: int
    end: int
    category: str = BLACK
    clean: str = ""
    children: list[tuple[int, int]] = field(default_factory=list)


def decompose(text: str, least: int = 4) -> list[Phrase]:
    """[N15, W9] Phrases with their places: paragraphs, sentences, phrases; short ones join the next, the last the one before."""
    cuts = {0, len(text)}
    at = 0
    for line in text.splitlines(keepends=True):
        if not line.strip() or _LIST_START.match(line):
            cuts.add(at)
        at += len(line)
    cuts |= {m.end() for m in re.finditer(r"[。；;！!？?，、,：:.\n]\s*", text)} | {m.start() for m in re.finditer("——", text)}
    bounds = sorted(cuts)
    out: list[Phrase] = []
    start = 0
    for end in bounds[1:]:
        if len(text[start:end].strip()) >= least:
            out.append(Phrase(text[start:end], start, end))
            start = end
    if start < len(text):
        if out:
            out[-1] = Phrase(text[out[-1].start :], out[-1].start, len(text))
        elif text.strip():
            out.append(Phrase(text, 0, len(text)))
    for p in out:
        left = len(p.text) - len(p.text.lstrip())
        p.text, p.start, p.end = p.text.strip(), p.start + left, p.start + left + len(p.text.strip())
        p.clean = purify(p.text)
    return [p for p in out if p.text]


def without_noise(text: str, least: int = 100) -> tuple[str, list[int]]:
    """[N16] A long text without runs of two or more foreign label lines, and the place that each kept character had."""
    if len(text) < least:
        return text, list(range(len(text)))
    lines, at = [], 0
    for line in text.split("\n"):
        s = line.strip()
        foreign = bool(s) and not re.search(f"[{T.CJK}]", s) and (len(s) <= 8 or bool(re.fullmatch(r"[A-Z0-9\-/.,()>=< ]{1,40}", s)))
        lines.append((at, len(line) + 1, foreign))
        at += len(line) + 1
    kept: list[int] = []
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j][2]:
            j += 1
        if j - i < 2:
            j = max(j, i + 1)
            for start, size, _ in lines[i:j]:
                kept += range(start, min(start + size, len(text)))
        i = j
    squeezed = [k for n, k in enumerate(kept) if not (text[k] == "\n" and n >= 2 and text[kept[n - 1]] == "\n" and text[kept[n - 2]] == "\n")]
    return "".join(text[k] for k in squeezed), squeezed


def classify(a: str, b: str, similarity: float, entail: Callable[[str, str], tuple[float, float, float]], o: MatchOptions = MatchOptions()) -> str:
    """The decision chain, in this order; ``entail`` is asked only where its answer can count."""
    if similarity < o.floor:
        return BLACK
    x, y = normal(a), normal(b)
    shortest, longest = sorted((len(x), len(y)))
    if similarity >= o.embedding_exact and longest and shortest / longest >= 0.70:
        if bigram_likeness(a, b) >= o.bigram_exact or charset_likeness(a, b) >= 0.88 and lcs_ratio(a, b) >= 0.80:
            return GREEN
    if len(a.strip()) <= 10 and len(b.strip()) <= 10 and a.strip() == b.strip():
        return GREEN
    if similarity >= 0.85 and x == y and len(x) >= o.min_phrase and min(len(a), len(b)) >= 0.50 * max(len(a), len(b)):
        return GREEN
    charset = charset_likeness(a, b)
    if similarity >= o.semantic:
        entailment, neutral, contradiction = entail(a, b)
        if contradiction >= o.contradiction:
            return BLACK
        if entailment >= o.entailment and charset >= o.charset_gate:
            return BLUE
        if neutral >= o.neutral and similarity >= 0.80 and charset >= o.charset_gate:
            return BLUE
    if similarity >= 0.85 and (lcs_ratio(a, b) >= 0.55 or charset >= 0.60):
        return BLUE
    if similarity >= 0.75 and charset >= 0.55 and lcs_ratio(a, b) >= 0.45:
        return BLUE
    return BLACK


def classified(sim: Column, bigram: Column, charset: Column, lcs: Column, length_ratio: Column, raw_equal_short: Column, normal_equal: Column, raw_ratio: Column, entailment: Column, neutral: Column, contradiction: Column, o: MatchOptions = MatchOptions()) -> Column:
    """The decision chain over known scores as one ``CASE``."""
    return (
        F.when(sim < o.floor, BLACK)
        .when((sim >= o.embedding_exact) & ((bigram >= o.bigram_exact) | ((charset >= 0.88) & (lcs >= 0.80))) & (length_ratio >= 0.70), GREEN)
        .when(raw_equal_short, GREEN)
        .when((sim >= 0.85) & normal_equal & (raw_ratio >= 0.50), GREEN)
        .when((sim >= o.semantic) & (contradiction >= o.contradiction), BLACK)
        .when((sim >= o.semantic) & (entailment >= o.entailment) & (charset >= o.charset_gate), BLUE)
        .when((sim >= 0.80) & (neutral >= o.neutral) & (charset >= o.charset_gate), BLUE)
        .when((sim >= 0.85) & ((lcs >= 0.55) | (charset >= 0.60)), BLUE)
        .when((sim >= 0.75) & (charset >= 0.55) & (lcs >= 0.45), BLUE)
        .otherwise(BLACK)
    )


def common_substrings(a: str, b: str, least: int = 4, cap: int = 200) -> list[tuple[int, int, int]]:
    """Maximal common stretches of two texts' starts: start in each, and length."""
    a, b = a[:cap], b[:cap]
    places: dict[str, list[int]] = {}
    for j in range(len(b) - least + 1):
        places.setdefault(b[j : j + least], []).append(j)
    out = []
    for i in range(len(a) - least + 1):
        for j in places.get(a[i : i + least], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # part of a stretch that began before
            size = least
            while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
                size += 1
            out.append((i, j, size))
    return sorted(out, key=lambda s: (s[0] + s[2], s[1] + s[2]))


def apart(spans: list[tuple[int, int, int]], most: int | None = None) -> list[tuple[int, int, int]]:
    """[O4] Spans (start, end, length) that don't overlap, longest first, then by start; in order of start."""
    out: list[tuple[int, int, int]] = []
    for start, end, size in sorted(spans, key=lambda s: (-s[2], s[0])):
        if all(end <= s or e <= start for s, e, _ in out) and (most is None or len(out) < most):
            out.append((start, end, size))
    return sorted(out)


def _mark_parts(own: list[Phrase], other: list[Phrase], sim: np.ndarray, o: MatchOptions) -> None:
    """Unmatched phrases that share long enough stretches with similar ones become GREEN, with those stretches."""
    for i, p in enumerate(own):
        if p.category != BLACK or len(p.text) < 4 or not len(other) or sim[i].max() < o.sub_phrase_floor:
            continue
        spans = []
        for j in np.argsort(-sim[i], kind="stable")[: o.sub_phrase_partners]:
            if sim[i, j] >= o.sub_phrase_floor:
                spans += [(s, s + n, n) for s, _, n in common_substrings(p.text, other[j].text, o.min_phrase, o.sequence_cap) if normal(p.text[s : s + n])]
        chosen = apart(spans, o.sub_phrase_spans)
        if chosen and sum(n for *_, n in chosen) <= o.sub_phrase_share * len(p.text):
            p.category, p.children = GREEN, [(p.start + s, p.start + e) for s, e, _ in chosen]


def _promote(own: list[Phrase], other: list[Phrase], partner: dict[int, int], sim: np.ndarray, o: MatchOptions) -> None:
    """A phrase rises to its partner's class, to GREEN only if they are very similar."""
    for i, p in enumerate(own):
        j = partner.get(i, int(sim[i].argmax()) if len(other) else -1)
        if j < 0 or sim[i, j] < o.promote_floor:
            continue
        theirs = other[j].category
        if PRIORITY[theirs] > PRIORITY[p.category] and (theirs != GREEN or sim[i, j] >= o.promote_green):
            p.category = theirs


def runs_of(text: str, phrases: list[Phrase]) -> list[tuple[str, str]]:
    """The whole text as stretches of one class; line feeds at a stretch's start go to the one before."""
    spans = [(start, end, p.category) for p in phrases for start, end in p.children or [(p.start, p.end)] if p.category != BLACK and end > start]
    parts, at = [], 0
    for start, end, category in sorted(spans):
        start = max(start, at)
        if start >= end:
            continue
        parts += [(at, start, BLACK), (start, end, category)]
        at = end
    out: list[list[str]] = []
    for start, end, category in [*parts, (at, len(text), BLACK)]:
        if out and out[-1][1] != category:
            lead = start
            while lead < end and text[lead] == "\n":
                lead += 1
            out[-1][0] += text[start:lead]
            start = lead
        if start < end:
            if out and out[-1][1] == category:
                out[-1][0] += text[start:end]
            else:
                out.append([text[start:end], category])
    return [(t, c) for t, c in out]


def symmetric(own: list[tuple[str, str]], other: list[tuple[str, str]], least: int = 4) -> list[tuple[str, str]]:
    """[J15] Unmatched stretches take the colour of the other side's coloured stretches that they hold."""
    for colour in (GREEN, BLUE):
        sought = sorted({t.strip() for t, c in other if c == colour and len(t.strip()) >= least}, key=lambda t: (-len(t), t))
        done: list[tuple[str, str]] = []
        for text, c in own:
            if c != BLACK or len(text) < least:
                done.append((text, c))
                continue
            spans = apart([(m.start(), m.end(), m.end() - m.start()) for t in sought for m in re.finditer(re.escape(t), text)])
            at = 0
            for start, end, _ in spans:
                done += [(text[at:start], BLACK)] * (start > at) + [(text[start:end], colour)]
                at = end
            done += [(text[at:], BLACK)] * (at < len(text))
        own = done
    return own


@dataclass
class _Pair:
    """A pair in the course of verification: phrases of both sides, their similarities and partners."""

    down: str
    up: str
    a: list[Phrase] = field(default_factory=list)
    b: list[Phrase] = field(default_factory=list)
    sim: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    partners: dict[int, int] = field(default_factory=dict)

    def split(self, o: MatchOptions) -> None:
        if not self.down.strip() or not self.up.strip():
            return
        for text, side in ((self.down, self.a), (self.up, self.b)):
            clean, places = without_noise(text)
            for p in decompose(clean, o.min_phrase):
                p.start, p.end = places[p.start], places[p.end - 1] + 1
                side.append(p)

    def match(self, vectors: Callable[[list[str]], np.ndarray], o: MatchOptions) -> None:
        if self.a and self.b:
            self.sim = vectors([p.clean for p in self.a]) @ vectors([p.clean for p in self.b]).T
            self.partners = dict(assign(self.sim, o.floor))

    def views(self) -> list[tuple[list[Phrase], list[Phrase], dict[int, int], np.ndarray]]:
        """Own and other phrases, own to other partners and similarities, seen from either side."""
        return [(self.a, self.b, self.partners, self.sim), (self.b, self.a, {j: i for i, j in self.partners.items()}, self.sim.T)]

    def compared(self) -> list[tuple[Phrase, Phrase, float]]:
        """Each phrase with its partner, or else the most similar one of the other side."""
        if not (self.a and self.b):
            return []
        return [(p, other[j], float(sim[i, j])) for own, other, partner, sim in self.views() for i, p in enumerate(own) for j in [partner.get(i, int(sim[i].argmax()))]]

    def questions(self, o: MatchOptions) -> set[tuple[str, str]]:
        return {(p.text, q.text) for p, q, similarity in self.compared() if similarity >= o.semantic}

    def result(self, answers: dict[tuple[str, str], tuple[float, float, float]], o: MatchOptions) -> dict:
        if not (self.a and self.b):
            return {"down_runs": [(self.down, BLACK)] if self.down else [], "up_runs": [(self.up, BLACK)] if self.up else [], "overall": BLACK}
        found = [(p, classify(p.text, q.text, similarity, lambda x, y: answers.get((x, y), (0.0, 0.0, 0.0)), o)) for p, q, similarity in self.compared()]
        for p, category in found:
            p.category = category
        for own, other, _, sim in self.views():
            _mark_parts(own, other, sim, o)
        for own, other, partner, sim in self.views():
            _promote(own, other, partner, sim, o)
        down_runs, up_runs = runs_of(self.down, self.a), runs_of(self.up, self.b)
        down_runs = symmetric(down_runs, up_runs)
        up_runs = symmetric(up_runs, down_runs)
        overall = max((p.category for p in self.a + self.b), key=PRIORITY.__getitem__)
        return {"down_runs": down_runs, "up_runs": up_runs, "overall": overall}


def verify_pairs(pairs: list[tuple[str | None, str | None]], encoder: Encoder = hashed_grams, entailment: Entailment = undecided, o: MatchOptions = MatchOptions()) -> list[dict]:
    """[P1, M11] Results of several pairs; the encoder and the entailment model are each asked once, about distinct phrases."""
    listed = [_Pair(down or "", up or "") for down, up in pairs]
    for pair in listed:
        pair.split(o)
    phrases = sorted({p.clean for pair in listed if pair.a and pair.b for p in pair.a + pair.b}, key=lambda t: (len(t), t))
    where, known = {t: i for i, t in enumerate(phrases)}, encoder(phrases) if phrases else np.zeros((0, 0))
    for pair in listed:
        pair.match(lambda texts: known[[where[t] for t in texts]], o)
    questions = sorted({q for pair in listed for q in pair.questions(o)})
    answers = dict(zip(questions, entailment(questions), strict=True)) if questions else {}
    return [pair.result(answers, o) for pair in listed]


def verify_pair(down: str | None, up: str | None, encoder: Encoder = hashed_grams, entailment: Entailment = undecided, o: MatchOptions = MatchOptions()) -> dict:
    """[P1] Runs of both texts and the overall class; an empty side makes all BLACK."""
    return verify_pairs([(down, up)], encoder, entailment, o)[0]


RUNS = "array<struct<text:string,category:string>>"


def verified(pairs: DataFrame, encoder: Encoder = hashed_grams, entailment: Entailment = undecided, o: MatchOptions = MatchOptions(), batch: int = 256) -> DataFrame:
    """[P1] ``pair_id``, ``down_runs``, ``up_runs``, ``overall`` and ``error`` of rows ``pair_id``, ``down``, ``up``.

    Pairs are dealt out evenly, and go through the models ``batch`` at a time. If a batch fails, its
    pairs are tried one by one; one that fails has null results and its error's text, and doesn't end the job.
    """

    def outcome(pair_id: int, r: dict) -> tuple:
        as_dicts = lambda runs: [{"text": t, "category": c} for t, c in runs]
        return pair_id, as_dicts(r["down_runs"]), as_dicts(r["up_runs"]), r["overall"], None

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), batch):
                frame = whole.iloc[at : at + batch]
                ids, texts = frame["pair_id"].tolist(), list(zip(frame["down"], frame["up"], strict=True))
                try:
                    rows = [outcome(i, r) for i, r in zip(ids, verify_pairs(texts, encoder, entailment, o), strict=True)]
                except Exception:  # noqa: BLE001
                    rows = []
                    for pair_id, (down, up) in zip(ids, texts, strict=True):
                        try:
                            rows.append(outcome(pair_id, verify_pair(down, up, encoder, entailment, o)))
                        except Exception as e:  # noqa: BLE001
                            rows.append((pair_id, None, None, None, repr(e)))
                yield pd.DataFrame(rows, columns=["pair_id", "down_runs", "up_runs", "overall", "error"])

    # a set number of partitions, since small tables with much work would else be put into one
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("pair_id", "down", "up").repartition(parts, "pair_id")
    return dealt.mapInPandas(verify, f"pair_id long, down_runs {RUNS}, up_runs {RUNS}, overall string, error string")

"""License scan by patience alignment of texts with license templates.

Words that occur once in both sequences are anchors. The longest run of anchors in the same order on
both sides is kept, and the gaps between them are aligned in the same way again. The share of the
template's words that are aligned, as against the stretch of text they span, is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

from pyspark.sql import DataFrame

from spanloom.llm.common import map_columns

#: Wordings by which texts name or grant a license.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Least share of a template's words that must be aligned, and of the spanned words that must be the template's.
MIN_COVERAGE, MIN_DENSITY = 0.8, 0.6

#: Frequent words, which are taken last when a text is searched for a template's words.
FREQUENT = frozenset("a above all and any be by following for from have in is may not of or other published so subject that the this to under use whom with work you".split())

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that also increases in the second."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [y]
        at[pile : pile + 1] = [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def patience(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences."""
    out: list[tuple[int, int]] = []
    while a and b and a[0] == b[0]:
        out.append((a0, b0))
        a, b, a0, b0 = a[1:], b[1:], a0 + 1, b0 + 1
    tail: list[tuple[int, int]] = []
    while a and b and a[-1] == b[-1]:
        tail.append((a0 + len(a) - 1, b0 + len(b) - 1))
        a, b = a[:-1], b[:-1]
    if a and b:
        in_a, in_b = Counter(a), Counter(b)
        where = {w: j for j, w in enumerate(b) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a) if w in where])
        last_a = last_b = 0
        for i, j in [*anchors, (len(a), len(b))] if anchors else []:
            out += patience(a[last_a:i], b[last_b:j], a0 + last_a, b0 + last_b)
            if i < len(a):
                out.append((a0 + i, b0 + j))
            last_a, last_b = i + 1, j + 1
    return out + tail[::-1]


@dataclass(frozen=True)
class Template:
    """A wording: its words and their counts, how many a notice must share, how long it can be, and words of which it has one.

    A notice aligns at least ``need`` words, so it shares as many with the template, and they are no
    less than ``MIN_DENSITY`` of it, so it has ``longest`` words at most. If it had none of ``cues``,
    which stand more than ``len(words) - need`` times in the template, it would share too few.
    """

    name: str
    words: tuple[str, ...]
    counts: dict[str, int]
    need: int
    longest: int
    cues: frozenset[str]


@lru_cache(maxsize=8)
def _templates(min_coverage: float) -> list[Template]:
    """All wordings, longest first."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = tuple(w.lower() for w in _WORD.findall(text))
            counts, need, cues = dict(Counter(words)), max(1, ceil(min_coverage * len(words) - 1e-9)), []
            for word in sorted(counts, key=lambda w: (w in FREQUENT, -len(w), w)):
                if sum(counts[w] for w in cues) <= len(words) - need:
                    cues.append(word)
            out.append(Template(name, words, counts, need, int(len(words) / MIN_DENSITY + 1e-9), frozenset(cues)))
    return sorted(out, key=lambda t: (-len(t.words), t.name, t.words))


def tight_stretches(words: list[str], template: Template, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``words[low:high]``, as begin and end, that share enough with a template and are tight.

    Tight means that without its first or its last word a stretch would share one word less, as
    multisets. Windows of the greatest length slide over the words, so only beginnings from which
    enough can be shared are looked at.
    """
    counts, longest = template.counts, template.longest
    have, shared, end = dict.fromkeys(counts, 0), 0, low
    for begin in range(low, high):
        while end < min(begin + longest, high):
            if (word := words[end]) in have:
                have[word] += 1
                shared += have[word] <= counts[word]
            end += 1
        if (first := words[begin]) not in have:
            continue
        if shared >= template.need:
            seen, n = {}, 0
            for at in range(begin, end):
                if (most := counts.get(word := words[at])) is None:
                    continue
                seen[word] = seen.get(word, 0) + 1
                if seen[word] <= most:
                    n += 1
                    if n >= template.need:
                        yield begin, at + 1
                elif word == first:
                    break
        have[first] -= 1
        shared -= have[first] < counts[first]


@lru_cache(maxsize=4096)
def _aligned(words: tuple[str, ...], template: tuple[str, ...]) -> tuple[int, int, int]:
    """How many words are aligned, and the first and last of the stretch that are."""
    pairs = patience(list(words), list(template))
    return (len(pairs), pairs[0][0], pairs[-1][0]) if pairs else (0, 0, 0)


def find_licenses(text: str, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, float]]:
    """License, span in code points and coverage of each notice, in order and without overlap.

    Every tight stretch of the text that shares enough words with a template is aligned with it, so
    no wording is missed for where it stands or how it is laid out. Of notices that overlap the best
    counts: by aligned words times coverage, then the longer template, then the one that comes first.
    """
    lowered = text.lower()
    asked = [t for t in _templates(min_coverage) if any(cue in lowered for cue in t.cues)]
    if not asked:
        return []
    spans = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]
    words = [word for word, _, _ in spans]
    places: dict[str, list[int]] = {cue: [] for t in asked for cue in t.cues}
    for i, word in enumerate(words):
        if word in places:
            places[word].append(i)
    options = set()
    for t in asked:
        parts: list[list[int]] = []  # neighbourhoods of cues that a notice could lie in
        for place in sorted(i for cue in t.cues for i in places[cue]):
            low, high = max(0, place - t.longest + 1), min(len(words), place + t.longest)
            if parts and low <= parts[-1][1]:
                parts[-1][1] = high
            else:
                parts.append([low, high])
        for begin, end in (stretch for part in parts for stretch in tight_stretches(words, t, *part)):
            n, first, last = _aligned(tuple(words[begin:end]), t.words)
            if n >= t.need and n >= MIN_DENSITY * (last - first + 1):
                options.add((-n * n / len(t.words), -len(t.words), begin + first, begin + last, t.name, n / len(t.words)))
    taken: list[tuple[int, int, str, float]] = []
    for _, _, first, last, name, coverage in sorted(options):
        at = bisect_left(taken, (first,))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
            taken.insert(at, (first, last, name, coverage))
    return [(name, spans[first][1], spans[last][2], coverage) for first, last, name, coverage in taken]


def scan_licenses(docs: DataFrame, *, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Find license notices in every whole text, without a shuffle.

    Returns ``doc_id``, ``n_notices``, ``licenses`` (sorted distinct names joined by commas, empty
    without any), ``coverage`` (of the best notice, 0 without any) and ``spans`` (``license:start:end``
    in code points, joined by commas). A null text counts as empty. Each row gives a row, whether ids
    are null or repeated; other columns are left out.
    """

    def scan(columns: dict[str, list]) -> dict[str, list]:
        found = [find_licenses(text, min_coverage) if text else [] for text in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "n_notices": list(map(len, found)),
            "licenses": [",".join(sorted({name for name, *_ in notices})) for notices in found],
            "coverage": [max((coverage for *_, coverage in notices), default=0.0) for notices in found],
            "spans": [",".join(f"{name}:{start}:{end}" for name, start, end, _ in notices) for notices in found],
        }

    schema = "doc_id long, n_notices long, licenses string, coverage double, spans string"
    return map_columns(docs.select("doc_id", "text"), scan, schema)

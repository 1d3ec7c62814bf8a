"""License notices against brute force, in every layout and beside each other."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from spanloom.llm import licenses

WORDINGS = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]


def brute(text, min_coverage=licenses.MIN_COVERAGE):
    """All stretches of all lengths against all templates; the best first, then what does not overlap."""
    spans = [(m[0].lower(), *m.span()) for m in licenses._WORD.finditer(text)]
    words = [w for w, _, _ in spans]
    options = []
    for name, wording in WORDINGS:
        template = [w.lower() for w in licenses._WORD.findall(wording)]
        counts = Counter(template)
        shared = lambda part: (Counter(part) & counts).total()  # noqa: B023, E731
        for i, j in itertools.combinations(range(len(words) + 1), 2):
            part = words[i:j]
            n = shared(part)
            if n < min_coverage * len(template) or shared(part[1:]) == n or shared(part[:-1]) == n:
                continue
            pairs = licenses.patience(part, template)
            if pairs and len(pairs) >= min_coverage * len(template) and len(pairs) >= licenses.MIN_DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                options.append((-len(pairs) ** 2 / len(template), -len(template), i + pairs[0][0], i + pairs[-1][0], name, len(pairs) / len(template)))
    taken = []
    for _, _, first, last, name, coverage in sorted(options):
        if all(last < a or first > b for a, b, _, _ in taken):
            taken.append((first, last, name, coverage))
    return [(name, spans[a][1], spans[b][2], coverage) for a, b, name, coverage in sorted(taken)]


def test_by_brute_force():
    rng = random.Random(6)
    short = [text for _, text in WORDINGS if len(text.split()) < 14]
    pool = [w for text in short for w in text.split()] + ["word", "software", "license", "the", "under", "4.0"]
    for n in range(60):
        words: list[str] = []
        while len(words) < 26:
            words += rng.choice(short).split() if rng.random() < 0.4 else rng.choices(pool, k=rng.randrange(1, 6))
        for _ in range(n % 6):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [rng.choice(pool)], [words[at], rng.choice(pool)], [words[at]] * 2])
        text = rng.choice([" ", "\n", " \n# * "]).join(words)
        assert licenses.find_licenses(text) == brute(text), text


@pytest.mark.parametrize("gap", [" ", "\n", "\n\nsome other words stand here\n"])
def test_notices_beside_each_other(gap):
    for (a, first), (b, second) in itertools.product(WORDINGS, repeat=2):
        text = f"{first}{gap}{second}{gap}{first}"
        found = licenses.find_licenses(text)
        assert [name for name, *_ in found][:1] in ([a], [b]) and {name for name, *_ in found} >= {a, b} and all(c == 1.0 for *_, c in found), text
        assert all(x[2] <= y[1] for x, y in itertools.pairwise(found))


@pytest.mark.parametrize("text, name", [("available under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Shared under CC BY 4.0", "CC-BY-4.0"), ("Released under the MIT", "MIT"), ("Redistribution and\n * use in source and binary forms, with or without\n * modification, are permitted provided that the\n * following conditions are met", "BSD-3-Clause")])
def test_no_word_is_needed(text, name):
    assert [n for n, *_ in licenses.find_licenses(f"a word\n{text} and more")] == [name]


def test_cues_are_a_bound():
    """Leaving out all cues leaves too few words."""
    for t in licenses._templates(licenses.MIN_COVERAGE):
        assert sum(n for word, n in t.counts.items() if word not in t.cues) < t.need


def test_many_notices():
    text = "Released under the MIT License. " * 3000
    assert len(licenses.find_licenses(text)) == 3000

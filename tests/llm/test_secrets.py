"""Random strings are found whatever their shape; words in the same shapes are not."""

from __future__ import annotations

import time

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from spanloom.llm import queries, secrets

RANDOM = ["qzxvkjwpghtrbnmdlfsqwkzj", "QZXVKJWPGHTRBNMDLFSQ", "qwkzj-xvbnt-plkmj-hgfds", "qzxvk83jwpgh2417trbnm91", "qzxvkjwpghtrbnmd"]
WORDS = ["internationalization", "INTERNATIONAL_BUSINESS_MACHINES", "get_number_of_documents", "HttpServletRequestWrapper", "2024-01-02-2024-03-04", "/usr/share/python/packages", "d41d8cd98f00b204e9800998ecf8427e"]


@pytest.fixture(scope="module")
def encoding():
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
        return secrets._encoding(file.read(), queries.pre_token_pattern())


@pytest.mark.parametrize("run", RANDOM)
def test_random_strings_are_found(encoding, run):
    assert secrets.random_spans(f"key {run} end", encoding, []) == [(4, 4 + len(run), "random")]


@pytest.mark.parametrize("run", WORDS)
def test_words_and_digests_are_left(encoding, run):
    assert secrets.random_spans(f"see {run} end", encoding, []) == []


@pytest.mark.parametrize("run", ["g" * 200 + "Z9x", "Ab" * 200, "ABCd" * 200 + "!", "a1" * 5000, "abc-" * 5000 + "Z9x"])
def test_long_runs_take_no_time(encoding, run):
    began = time.perf_counter()
    secrets.is_known(run, encoding)
    assert time.perf_counter() - began < 0.05


def test_runs_beside_fixed_spans(encoding):
    """Runs are tested against all spans, also where a long one starts before shorter ones end."""
    run = RANDOM[0]
    assert secrets.random_spans(run, encoding, [(0, 2, "hex")]) == [] == secrets.random_spans(f"ab {run}", encoding, [(0, 30, "assign"), (1, 2, "hex")])
    assert secrets.random_spans(f"ab {run}", encoding, [(0, 3, "assign"), (27, 30, "hex")]) == [(3, 27, "random")]


BASE_SQL = r"""
WITH hits AS (
  SELECT doc_id, 'hex' AS kind, unnest(regexp_extract_all(text, '[0-9a-f]{24,}')) AS hit FROM documents
  UNION ALL SELECT doc_id, 'access', unnest(regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}')) FROM documents
  UNION ALL SELECT doc_id, 'assign', hit FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) AS hit FROM documents
  ) WHERE length(hit) >= 6
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign'), count(*) FILTER (WHERE kind = 'access'), count(*) FILTER (WHERE kind = 'hex')
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id
"""


def test_base_counts_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = queries.op7_secrets(spark, "/root/testdata/sf0.01").select("doc_id", "n_assign", "n_access", "n_hex").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(BASE_SQL).fetchall())


def brute_spans(text):
    """Leftmost matches found by trying every place, without the pattern engine's search."""
    hits, lower = [], text.lower() if text.isascii() else text
    for kind in ("assign", "access", "hex"):
        at = 0
        while at < len(text):
            end = None
            if kind == "hex":
                end = at
                while end < len(text) and text[end] in "0123456789abcdef":
                    end += 1
                good = end - at >= 24
            elif kind == "access":
                end = at
                if text.startswith("AKIA", at):
                    end = at + 4
                    while end < len(text) and text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                        end += 1
                    end = end if end > at + 4 else at
                good = end - at >= 20
            else:
                word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(w, at)), None)
                end, good = at, False
                if word:
                    j = at + len(word)
                    j += text[j : j + 1] in ("'", '"')
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in (":", "="):
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        j += text[j : j + 1] in ("'", '"')
                        start = j
                        while j < len(text) and (text[j].isascii() and text[j].isalnum() or text[j] in "+/_.=-"):
                            j += 1
                        if j > start:
                            end, good = j, j - start >= 6
            if end > at:
                if good:
                    hits.append((at, end, kind))
                at = end
            else:
                at += 1
    return sorted(hits, key=lambda h: (h[0], ("assign", "access", "hex").index(h[2])))


@given(st.lists(st.sampled_from(["password", "Secret", "TOKEN", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH01234567", "deadbeef0123", "x", "\n", "é", "+/"]), max_size=14))
def test_base_spans_by_brute_force(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == brute_spans(text)

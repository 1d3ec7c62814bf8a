"""Secret scan: fixed patterns, and a test of how few characters a token covers.

Ordinary words are long pieces of a vocabulary; random strings fall apart into short ones. So a long
unbroken run with few characters per token is reported as ``random``, unless it is a digest or an
identifier. The fixed patterns report ``assign``, ``access`` and ``hex`` whatever that test says.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from spanloom.llm.common import map_columns, release_memory, resident, small_batches

KINDS = ("assign", "access", "hex", "random")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.ASCII | re.IGNORECASE)
#: A run of one class is one match, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

_HEX_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_BASE64_DIGEST = re.compile(r"(?:sha1-[A-Za-z0-9+/]{27}=|sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The shape of an identifier: words of one case or with a capital, short words before a sign, short numbers, and
#: signs of paths and names. Each part is as long as it can be and never tried anew, so the time is linear.
_IDENTIFIER = re.compile(
    r"""(?:
        [/_+=-]++
      | (?:[A-Z]{3,}+|[A-Z])?+[a-z]{3,}+
      | [A-Z]{3,}+(?:[a-z]{1,2}+(?=[/_+-])|(?![a-z]))
      | (?:[a-z]{1,2}+|[A-Z]{1,2}+)(?=[/_+-])
      | (?<=[A-Za-z])(?:[0-9]{1,4}+(?=[A-Za-z])|[0-9]{1,12}+(?![0-9A-Za-z]))
      | (?<![A-Za-z0-9])[0-9]{1,8}+(?![0-9A-Za-z])
    )*+""",
    re.VERBOSE,
)

#: Characters per token below which a run counts as random. Words give 3 to 6, random letters and digits below 2.
MAX_RATIO = 2.2


def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, ranks.splitlines()))}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns in code points, by start and then kind as listed."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], _RANK[span[2]]))


def is_known(run: str, encoding: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run is a digest of a usual length and form, or an identifier: its letters are words, which take few tokens."""
    if _HEX_DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _BASE64_DIGEST.fullmatch(run):
        return True
    if not _IDENTIFIER.fullmatch(run):
        return False
    words = _WORD.findall(run)
    # in lower case, since a vocabulary has few pieces of capitals
    tokens = sum(min(len(encoding.encode_ordinary(word)), len(encoding.encode_ordinary(word.lower()))) for word in words)
    return sum(map(len, words)) >= max_ratio * tokens


def random_spans(text: str, encoding: tiktoken.Encoding, taken: list[tuple[int, int, str]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Runs of low token efficiency that no span of ``taken``, which is sorted, overlaps."""
    starts, ends = [start for start, _, _ in taken], list(accumulate((end for _, end, _ in taken), max))
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        before = bisect_right(starts, m.end() - 1)  # so many start before the run ends
        if before and ends[before - 1] > m.start():
            continue
        if len(run) / len(encoding.encode_ordinary(run)) < max_ratio and not is_known(run, encoding, max_ratio):
            found.append((*m.span(), "random"))
    return found


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover, alone or together, replaced by one mark."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda span: (span[0], -span[1])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _shared(docs: DataFrame, ranks_path: str, pattern: str) -> tuple:
    """The vocabulary (under 1 MB) as a broadcast value, and a name for what is made of it."""
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    return docs.sparkSession.sparkContext.broadcast(ranks), ("secrets", hashlib.sha256(ranks).hexdigest(), pattern)


def scan_documents(docs: DataFrame, ranks_path: str, pattern: str, *, max_ratio: float = MAX_RATIO, with_text: bool = False) -> DataFrame:
    """Find secrets in every whole text, without a shuffle.

    Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` (of the
    fixed patterns' spans), ``spans`` (all of them) and, if asked for, ``redacted_text``. A null text
    counts as empty and its redacted text stays null. Each row gives a row, whether ids are null or
    repeated; other columns are left out. The vocabulary (under 1 MB) is broadcast.
    """
    ranks, label = _shared(docs, ranks_path, pattern)

    def scan(columns: dict[str, list]) -> dict[str, list]:
        encoding = resident(label, lambda: _encoding(ranks.value, pattern))
        out: dict[str, list] = {name: [] for name in (*(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "redacted_text")}
        for text in columns["text"]:
            base = base_spans(text) if text else []
            more = random_spans(text, encoding, base, max_ratio) if text else []
            spans = sorted(base + more, key=lambda span: (span[0], _RANK[span[2]]))
            kinds = [kind for _, _, kind in spans]
            row = (*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans))
            for name, value in zip(out, (*row, redacted(text, spans) if text and with_text else text), strict=True):
                out[name].append(value)
        return {"doc_id": columns["doc_id"], **out}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return map_columns(docs.select("doc_id", "text"), scan, schema + ", redacted_text string" * with_text)


def redact_documents(docs: DataFrame, ranks_path: str, pattern: str, *, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The rows of ``docs`` with secrets in ``text`` replaced by marks and ``n_chars`` set to the new length.

    Other columns stay as they are; a null text stays null and keeps its ``n_chars``. Each row gives a
    row, whether ids are null or repeated; an empty table stays empty.
    """
    ranks, label = _shared(docs, ranks_path, pattern)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = resident(label, lambda: _encoding(ranks.value, pattern))
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    texts[i] = redacted(text, base + random_spans(text, encoding, base, max_ratio))
            lengths = [known if text is None else len(text) for text, known in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
            changed = {"text": texts, "n_chars": lengths}
            columns = [pa.array(changed[f.name], f.type) if f.name in changed else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        release_memory()

    return docs.mapInArrow(redact, docs.schema)

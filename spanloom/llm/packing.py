"""Packing of token sequences by the sum-of-squares rule.

A document's ids are cut from the end into full pieces, so only its first piece may be shorter.
Full pieces fill a sequence each. Every other piece goes where the sum of the squared numbers of
open sequences per residual gap becomes smallest. The smallest pieces, a tenth of all tokens, are
placed last by the same rule, but open a sequence only where none has room: they fill the gaps that
the rule keeps open.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from spanloom.llm.bpe import BYTE_TO_CHAR
from spanloom.llm.common import map_columns, materialise, release_memory, resident

CAPACITY = 2048
SEPARATOR_ID = 0
#: Pieces that one task packs. Fewer would leave more gaps; more would need more memory in a task.
SHARD_PIECES = 200_000
LAST_SHARE = 0.1
#: Fixed value: how a byte-level pre-tokenizer with ``use_regex`` splits text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def place_pieces(lengths: np.ndarray, capacity: int = CAPACITY, last_share: float = LAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths lie between 1 and the capacity."""
    lengths = np.asarray(lengths, "int64")
    order = np.argsort(-lengths, kind="stable")
    late = np.cumsum(lengths[order][::-1])[::-1] <= last_share * lengths.sum()
    counts = np.zeros(capacity + 1, "int64")  # open sequences by gap
    open_by_gap: dict[int, list[int]] = {}
    fill: list[int] = []
    sequence, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    never = np.iinfo("int64").max
    for at, is_late in zip(order.tolist(), late.tolist(), strict=True):
        size = int(lengths[at])
        gap, chosen = capacity, None
        if size < capacity:
            now = counts[size:capacity]
            change = np.where(now > 0, 2 * (counts[: capacity - size] - now) + 2, never)
            if now[0]:
                change[0] = 1 - 2 * now[0]  # it fills up and is open no more
            best = int(change.argmin())
            if change[best] < never and (is_late or change[best] <= 2 * counts[capacity - size] + 1):
                gap = size + best
                chosen = open_by_gap[gap].pop()
                counts[gap] -= 1
        if chosen is None:
            chosen = len(fill)
            fill.append(0)
        sequence[at], offset[at] = chosen, fill[chosen]
        fill[chosen] += size
        if left := gap - size:
            counts[left] += 1
            open_by_gap.setdefault(left, []).append(chosen)
    return sequence, offset


@dataclass
class Vocabulary:
    """A byte-level tokenizer definition, its tokens' ranks, the ids that ranks alone don't explain, its added
    tokens, and whether nothing else in the definition changes a text's ids."""

    definition: str
    ranks: dict[bytes, int]
    doubtful: frozenset[int]
    added: tuple[str, ...] = ()
    plain: bool = True


def _merged_by_rank(token: bytes, ranks: dict[bytes, int], pairs: set[tuple[bytes, bytes]]) -> bool:
    """Whether merging a token's bytes by rank ends in the token and uses only the pairs listed."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(pairwise(parts)) if x + y in ranks]
        if not found:
            return False
        _, i = min(found)
        if (parts[i], parts[i + 1]) not in pairs:
            return False
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file and find which tokens a merge by ranks gets as the listed merges do.

    The listed merges are pairs, while a merge by ranks joins any neighbours that make up a token. If
    every token of a result is one whose merge by ranks uses listed pairs only, in the order of
    their ranks, the listed merges take the same steps and give the same result.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    whole = json.loads(definition)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    plain = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True) and not any(
        [*(whole.get(part) for part in ("normalizer", "truncation", "padding")), *(model.get(part) for part in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))]
    )
    to_byte = {c: b for b, c in enumerate(BYTE_TO_CHAR)}
    as_bytes = lambda piece: bytes(map(to_byte.__getitem__, piece))
    ids = {as_bytes(piece): i for piece, i in model["vocab"].items() if to_byte.keys() >= set(piece)}
    merges = [tuple(map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]
    in_order = [ids[x + y] for x, y in merges]
    pairs = set(merges)
    sound = in_order == sorted(in_order) and max(ids[bytes([b])] for b in range(256)) < in_order[0]
    doubtful = frozenset(i for token, i in ids.items() if not (sound and _merged_by_rank(token, ids, pairs)))
    return Vocabulary(definition, ids, doubtful, tuple(token["content"] for token in whole.get("added_tokens") or ()), plain)


class ExactTokenizer:
    """The ids that the tokenizer of a definition gives, mostly found by ranks, which is several times faster.

    Texts that hold an added token, special or not, go through the tokenizer itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokenizer = Tokenizer.from_str(vocabulary.definition)
        self.added, self.plain = vocabulary.added, vocabulary.plain
        self.by_rank = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.doubtful = vocabulary.doubtful

    def encode(self, text: str) -> list[int]:
        if self.plain and not any(content in text for content in self.added):
            ids = self.by_rank.encode_ordinary(text)
            if not self.doubtful or self.doubtful.isdisjoint(ids):
                return ids
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and the closing separator, without a shuffle."""
    known = read_vocabulary(tokenizer_path)
    vocabulary, label = docs.sparkSession.sparkContext.broadcast(known), ("packing", hashlib.sha256(known.definition.encode()).hexdigest())

    def cut(columns: dict[str, list]) -> dict[str, list]:
        tokenizer = resident(label, lambda: ExactTokenizer(vocabulary.value))
        out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            body = array("I", [*tokenizer.encode(text or ""), SEPARATOR_ID]).tobytes()
            total = len(body) // 4
            first = total % capacity or capacity
            for piece, start in enumerate([0, *range(first, total, capacity)]):
                stop = start + (capacity if piece else first)
                part = body[4 * start : 4 * stop]
                for name, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(part)), strict=False):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype("int32"))
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_columns(docs.select("doc_id", "text"), cut, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and, if asked for, ``ids``. A null text counts as empty, so its
    document is the separator alone. Null and repeated ids are packed like any other row, and
    columns besides ``doc_id`` and ``text`` are left out. An empty table gives an empty result.

    Only lengths are dealt out, evenly and whatever the keys are, to tasks of about
    ``shard_pieces``; each packs its share by itself, which costs at most the last open sequences of
    each share. A repeated task sorts its rows first and so makes the same decisions.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity=capacity, with_ids=with_ids))
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := [batch for batch in batches if batch.num_rows]):
            return
        rows = pa.Table.from_batches(found).sort_by([(name, "ascending") for name in ("doc_id", "piece", "length", "ids_crc32")])
        sequence, offset = place_pieces(rows["length"].to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array((TaskContext.get().partitionId() << 40) + sequence))
        yield from rows.append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)
        release_memory()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return pieces.repartition(shards).mapInArrow(pack, schema + ", sequence_id long, offset long")

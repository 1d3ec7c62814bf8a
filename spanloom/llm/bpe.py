"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

The model is never trained. Each token of the vocabulary becomes a piece: its bytes are mapped one
by one to printable characters and its score is its negative rank, so that the best-scored merge is
the one of the lowest rank. Normalisation is the identity. A document is cut by the pre-token
pattern, each pre-token is encoded by the model, and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import regex
import sentencepiece
from pyspark.sql import DataFrame

from spanloom.llm.common import RecentCache, map_columns, resident, spaced_chunks

_BPE, _NORMAL, _UNKNOWN = 2, 1, 2


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


BYTE_TO_CHAR = byte_characters()
_TO_CHARS = {b: c for b, c in enumerate(BYTE_TO_CHAR)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ``ModelProto`` in wire format; piece ids equal ranks, the unknown piece comes last."""
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token, rank in by_rank:
        piece = token.decode("latin-1").translate(_TO_CHARS).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, _NORMAL))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, _UNKNOWN))
    unknown = len(by_rank)
    trainer = _number(3, _BPE) + _number(4, unknown + 1) + _number(40, unknown)
    for field in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(field << 3) + b"\xff" * 9 + b"\x01"
    out += _message(2, trainer)
    out += _message(3, _message(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5)))
    return bytes(out)


class ByteBPE:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size() - 1
        to_byte = {c: b for b, c in enumerate(BYTE_TO_CHAR)}
        pieces = self.processor.id_to_piece(list(range(size)))
        self.tokens = [bytes(map(to_byte.__getitem__, piece)) for piece in pieces]
        self.whole = {token.decode("latin-1").translate(_TO_CHARS): i for i, token in enumerate(self.tokens)}
        self._numbers = list(range(size))  # one object for each id in all memos
        self._decimal = [str(i) for i in range(size)]
        self.pattern = regex.compile(pattern)
        self._spaced = RecentCache(lambda chunk: self._encode_chunk(" " + chunk))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for token in self.pattern.findall(chunk):
            mapped = token.encode("utf-8", "replace").decode("latin-1").translate(_TO_CHARS)
            known = self.whole.get(mapped)
            if known is None:
                ids += self.processor.encode(mapped)
            else:
                ids.append(known)
        return tuple(map(self._numbers.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        first, *rest = spaced_chunks(text)
        self._spaced.room()
        return [*self._encode_chunk(first), *chain.from_iterable(map(self._spaced.__getitem__, rest))]

    def decimal(self, ids: list[int]) -> bytes:
        return ",".join(map(self._decimal.__getitem__, ids)).encode()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """Encode and decode the whole text of every row, without any shuffle.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the bytes got back from the ids) and, if asked for, ``ids``.
    A null text counts as empty: no tokens. Ids may be null or repeated; each row gives one row.
    Other columns are left out, whatever their names. The model (under 1.5 MB) is broadcast.
    """
    serialised = serialise_model(read_ranks(vocabulary))
    model, name = docs.sparkSession.sparkContext.broadcast(serialised), ("bpe", hashlib.sha256(serialised).hexdigest(), pattern)

    def encode(columns: dict[str, list]) -> dict[str, list]:
        bpe = resident(name, lambda: ByteBPE(model.value, pattern))
        ids = [bpe.encode(text) if text else [] for text in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [hashlib.sha256(bpe.decimal(x)).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            "ids": ids if with_ids else None,
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_columns(docs.select("doc_id", "text"), encode, schema)

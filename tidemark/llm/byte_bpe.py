"""Operator 2: byte-level BPE through a sentencepiece model built from the ranks.

A rank file lists byte strings; the lower the rank, the earlier the merge. ``rank_model``
writes that vocabulary as a sentencepiece BPE model without training: every byte string
is spelt with one printable character a byte, scored by its negative rank, under
identity normalisation. sentencepiece then merges the best-scored neighbours, leftmost
first, which is the rank order. Texts are cut by the pattern first and each pre-token
is encoded by itself; ids are the ranks, and decoding looks the byte strings up.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows that repeat
stay; an empty table gives an empty result; columns beside the text pass through
``encode`` only where named, and may have any name but ids and decoded.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, arrow_map, checked_keep, gather, string_list


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: base64 and a number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """One printable character for each byte: Latin-1's own where printable, else from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


# Fixed values of the sentencepiece model format (field numbers and enumerations).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 4, 40, 41, 42, 43, 45
NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5
NORMAL_PIECE, UNKNOWN_PIECE, BPE_MODEL = 1, 2, 2


def rank_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece i is the byte string of rank i, the unknown piece comes last."""
    letters, size = byte_alphabet(), len(ranks)
    if sorted(ranks.values()) != list(range(size)):
        raise ValueError("ranks must be 0 to n - 1")
    unknown = "⁇unknown⁇".encode()
    out = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        spelt = "".join(letters[b] for b in piece).encode()
        out.append(_field(PIECES, _field(PIECE, spelt) + _field(SCORE, -float(rank)) + _field(TYPE, NORMAL_PIECE)))
    out.append(_field(PIECES, _field(PIECE, unknown) + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN_PIECE)))
    none = (1 << 64) - 1  # -1 as a varint
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE_MODEL) + _field(VOCAB_SIZE, size + 1) + _field(UNK_ID, size) + _field(BOS_ID, none) + _field(EOS_ID, none) + _field(PAD_ID, none) + _field(UNK_PIECE, unknown)))
    out.append(_field(NORMALIZER, _field(NAME, b"identity") + _field(DUMMY_PREFIX, 0) + _field(EXTRA_BLANKS, 0) + _field(ESCAPE_BLANKS, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.pieces = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=rank_model(ranks))
        self.pattern = regex.compile(pattern)
        self.spell = {i: c for i, c in enumerate(byte_alphabet())}
        self.memo = Memo(self._token)
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _token(self, token: str) -> bytes:
        ids = self.model.encode(token.encode("utf-8").decode("latin-1").translate(self.spell), num_threads=1)
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


@lru_cache(maxsize=2)
def bpe_of(path: str, pattern: str) -> ByteBpe:
    """One coder a Python worker, so its model and memo serve the worker's later tasks too."""
    return ByteBpe(path, pattern)


def _int_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(ends[:-1], ends[1:]))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns and ``ids``: the ranks of each whole text's tokens."""
    checked_keep(keep, "ids")

    def make():
        bpe = bpe_of(ranks, pattern)
        return lambda b: pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [_int_lists([bpe.encode(t) for t in string_list(b.column(text))])], names=[*keep, "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return arrow_map(docs, [*keep, text], make, f"{kept}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded``: the bytes the ids stand for; null ids as none."""
    checked_keep(keep, "ids", "decoded")

    def make():
        bpe = bpe_of(ranks, pattern)
        return lambda b: pa.RecordBatch.from_arrays([b.column(c) for c in [*keep, "ids"]] + [pa.array([bpe.decode(x) for x in _lists(b.column("ids"))], pa.binary())], names=[*keep, "ids", "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return arrow_map(encoded, [*keep, "ids"], make, f"{kept}, ids array<int>, decoded binary")

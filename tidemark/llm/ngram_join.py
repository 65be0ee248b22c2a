"""Operator 12: documents joined by the Jaccard similarity of their word shingles.

Shingles have one global order, rarest first by how many documents a counter array of
bounded size says hold them; any order gives the same result. Two sets of similarity t
share at least ``t * n`` shingles, n the size of either, so among the first
``n - ceil(t * n) + m`` of each they share at least m. Each document chooses its own m:
a longer prefix meets more documents but asks for more meetings, and what the counters
say of the prefix's shingles prices both. Two documents are verified if they share as many
prefix shingles as the smaller m of the two: the longer prefix holds the shorter one.

Documents with equal sets form a class; only classes are joined. How classes that share
shingles become candidates without all pairs of a frequent shingle being made, and how
candidates are compared on full sets, is that of ``near_dedup.linked``: stars first, then
those that stars leave in different components, pair by pair where few share a shingle
and chunk by chunk where many do.

Defined cases: as near_dedup's: null texts and those without words link with nothing, fewer
words than a shingle are one shingle; rows with a null doc_id are dropped; rows that repeat
a doc_id give one result, of one of their texts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, release_memory, release_shuffles, text_batches, whole_texts
from .near_dedup import Shingler, _longs, _signed_pair, by_document, classes_of, linked


@dataclass(frozen=True)
class JoinSpec:
    words: int = 5
    percent: int = 80
    #: Counters of shingles, a byte each; the more, the fewer documents that a shingle's counter holds by chance.
    cells: int = 1 << 24
    #: Numbers of shared prefix shingles that a document chooses from.
    needs: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128)
    #: What verifying a pair costs, in rows of a prefix.
    verify: float = 32.0
    pairs: int = 32
    chunk: int = 400
    chunk_shingles: int = 400_000


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


#: What a counter's byte stands for, rounded down: all counts to 64, then twelve steps to each doubling, to four millions.
LEVELS = np.concatenate([np.arange(64), np.floor(64 * 2 ** (np.arange(192) / 12))]).astype(np.int64)


class Levels:
    """Counts kept as a byte each, looked up as an array of counts is."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        return LEVELS[self.codes[cells]]

    def mean(self) -> float:
        return float(np.bincount(self.codes, minlength=len(LEVELS)) @ LEVELS / len(self.codes))


def packed(counts: np.ndarray) -> tuple[bytes, int]:
    """Counts as compressed planes of their bits, about as many bits as their spread holds; and how many planes."""
    bits = int(counts.max()).bit_length()
    return pa.compress(b"".join(np.packbits((counts >> k & 1).astype(bool)).tobytes() for k in range(bits)), "zstd", asbytes=True), bits


def unpacked(planes: bytes, bits: int, n: int) -> np.ndarray:
    size = -(-n // 8)
    flat = np.frombuffer(pa.decompress(planes, bits * size, "zstd"), np.uint8).reshape(bits, size)
    return sum((np.unpackbits(flat[k], count=n).astype(np.int64) << k for k in range(bits)), np.zeros(n, np.int64))


def document_counts(docs: DataFrame, spec: JoinSpec, most: int = 1 << 16) -> Levels:
    """How many documents' shingles fall in each of ``cells`` cells of hashes: never less than a shingle's own count but for the rounding of ``LEVELS``. A byte a cell reaches the driver."""
    block = min(most, spec.cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(spec), np.zeros(spec.cells, np.uint32)
        for b in text_batches(batches):
            for own in shingler.sets(whole_texts(b.column("text"))):
                np.add.at(total, cells_of(own, spec.cells), np.uint32(1))
        for at in range(0, spec.cells, block):
            if total[at : at + block].any():
                planes, bits = packed(total[at : at + block])
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([planes]), pa.array([bits])], names=["block", "planes", "bits"])
        del total
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, planes, bits in zip(*(b.column(c).to_pylist() for c in ("block", "planes", "bits"))):
                held[at] = held.get(at, 0) + unpacked(planes, bits, block)
        for at, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([(np.searchsorted(LEVELS, total, "right") - 1).astype(np.uint8).tobytes()], pa.binary())], names=["block", "codes"])
        release_memory()

    parts = docs.where("doc_id is not null").select("text").mapInArrow(count, "block long, planes binary, bits long")
    codes = np.zeros(spec.cells, np.uint8)
    for r in parts.repartition("block").mapInArrow(add, "block long, codes binary").collect():
        codes[r["block"] : r["block"] + block] = np.frombuffer(r["codes"], np.uint8)
    release_shuffles(docs.sparkSession)
    return Levels(codes)


def prefix(own: np.ndarray, counts: np.ndarray | Levels, usual: float, spec: JoinSpec) -> tuple[int, np.ndarray]:
    """How many prefix shingles a partner of this set must share, and the prefix: the cheapest by what the counters say.

    A prefix costs a row a shingle, a meeting for each document beyond the ``usual`` that
    a counter holds by chance, and a verification for every m meetings.
    """
    held = counts[cells_of(own, spec.cells)]
    order = np.lexsort((own, held))
    met = np.cumsum(np.maximum(0, held[order] - usual))
    shared = -(-spec.percent * len(own) // 100)
    most = max(1, min(shared, len(own)))
    choices = np.array([m for m in spec.needs if m <= most])
    ends = len(own) - most + choices
    cost = ends + met[ends - 1] * (1 + spec.verify / choices)
    best = int(cost.argmin())
    return int(choices[best]), own[order[: ends[best]]]


def prefixes(docs: DataFrame, counts: Levels, spec: JoinSpec) -> DataFrame:
    """doc_id, n (size of its set), hi and lo (128-bit hash of the set), need and keys (how many of these a partner must share)."""
    import xxhash

    shared, usual = docs.sparkSession.sparkContext.broadcast(counts), counts.mean() + 4 * counts.mean() ** 0.5

    def make():
        shingler, held = Shingler(spec), shared.value

        def one(b):
            sets = shingler.sets(whole_texts(b.column("text")))
            pairs = [_signed_pair(xxhash.xxh3_128_intdigest(s.tobytes())) for s in sets]
            chosen = [prefix(s, held, usual, spec) if len(s) else (1, s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hi for hi, _ in pairs], pa.int64()), pa.array([lo for _, lo in pairs], pa.int64()), pa.array([m for m, _ in chosen], pa.int32()), _longs([k for _, k in chosen])],
                names=["doc_id", "n", "hi", "lo", "need", "keys"],
            )

        return one

    return arrow_map(docs.where("doc_id is not null"), ["doc_id", "text"], make, "doc_id long, n long, hi long, lo long, need int, keys array<long>")


def similar_documents(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    named, classes, shared = classes_of(prefixes(docs, document_counts(docs, spec), spec))
    return by_document(named, classes, linked(shared, classes, docs, spec))

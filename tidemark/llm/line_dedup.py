"""Operator 9: lines that other documents hold already.

A line's key is its bytes, ASCII white space stripped at both ends and A-Z lowered. Keys
of at least ``least`` code points that occur in two documents or more lose their lines
in all of them but the one with the smallest doc_id.

128-bit key hashes are range-partitioned, with a secondary sort by document and position,
and each partition streams through its first occurrences. The range key includes the
document, so a key that a third of all lines hold spreads over many partitions; what a
partition can't know, whether its first run goes on from an earlier partition, is settled
by one (hash, document) row a partition. Only hashes and positions are shuffled, and the
result is a compressed keep bitmap for each document that loses lines.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are the
same document (equal texts share a bitmap, other texts have their own); rows with a null
doc_id keep all lines and count for no other document; an empty table gives an empty
result; other columns of the input pass through ``apply_bitmaps`` untouched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, string_list

BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in text.encode().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def row_tag(text: str) -> int:
    """Tells apart rows that share a doc_id but not the text."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """hi, lo (128-bit hash of the key), doc_id, tag, pos: a row for each line that counts."""
    import xxhash

    def make():
        def one(b):
            digests, ids, tags, at = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), string_list(b.column("text"))):
                if doc is None:
                    continue
                own = [(xxhash.xxh3_128_digest(k), i) for i, k in enumerate(line_keys(text)) if _long_enough(k, least)]
                digests += [d for d, _ in own]
                at += [i for _, i in own]
                ids += [doc] * len(own)
                tags += [row_tag(text)] * len(own)
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(at, pa.int32())], names=["hi", "lo", "doc_id", "tag", "pos"])

        return one

    return arrow_map(docs, ["doc_id", "text"], make, "hi long, lo long, doc_id long, tag long, pos int")


def _first_occurrences(batches):
    """Streams one sorted partition.

    Rows out: kind 0, a line to drop; kind 1, a line of the first document of the
    partition's first run, to be dropped if that run began earlier; kind 2, the last
    run's hash and first document here.
    """
    part, run, first_doc, opening = TaskContext.get().partitionId(), None, None, True
    names = ["kind", "part", "hi", "lo", "doc_id", "tag", "pos"]
    types = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        hi, lo, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "doc_id"))
        new = np.empty(n, bool)
        new[0] = run is None or run != (hi[0], lo[0])
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1  # the run of this batch a row is in, -1: the run carried over
        firsts = np.where(which >= 0, doc[starts[np.maximum(which, 0)]] if len(starts) else 0, 0 if first_doc is None else first_doc)
        opens = opening & (which <= (0 if run is None else -1))
        drop = doc != firsts
        take = np.flatnonzero(drop | opens)
        kinds = np.where(drop[take], 0, 1).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(take), part, np.int32)), *(b.column(c).take(pa.array(take)) for c in names[2:])], names=names)
        opening = bool(opens[-1])
        run, first_doc = (hi[-1], lo[-1]), firsts[-1]
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([2, part, run[0], run[1], first_doc, 0, 0], types)], names=names)


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """doc_id, tag, pos of the lines that go."""
    order = ["hi", "lo", "doc_id", "pos"]
    streamed = hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_occurrences, "kind byte, part int, hi long, lo long, doc_id long, tag long, pos int")
    streamed = stored(streamed, "first-lines")
    sure = streamed.where("kind = 0").select("doc_id", "tag", "pos")
    ends = streamed.where("kind = 2").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"))
    open_ = streamed.where("kind = 1").join(ends, ["hi", "lo"]).where(F.col("first_doc") < F.col("doc_id"))
    return sure.unionByName(open_.select("doc_id", "tag", "pos"))


def pack(positions: list[int]) -> bytes:
    """Keep bitmap up to the last dropped line, compressed; bit 1 keeps, absent bits keep."""
    bits = np.ones(-(-(max(positions, default=-1) + 1) // 8) * 8, np.uint8)  # whole bytes, spare bits keep
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` lines to keep."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, tag, bitmap for each document that loses lines."""

    def make():
        def one(b):
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array([pack(x) for x in b.column("gone").to_pylist()], pa.binary())], names=["doc_id", "tag", "bitmap"])

        return one

    gone = dropped_lines(line_hashes(docs, least)).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("gone"))
    return arrow_map(gone, ["doc_id", "tag", "gone"], make, "doc_id long, tag long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` with text as kept, and n_lines and n_dropped (clashing names give way).

    ``text`` is null where the input's was null.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    held = next(n for n in ("_bitmaps" + "_" * i for i in range(len(columns) + 1)) if n not in columns)
    own = bitmaps.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "bitmap")).alias(held))
    joined = docs.select(*columns).join(own, "doc_id", "left").select(*columns, held)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def make():
        def one(b):
            texts, total, gone = [], [], []
            for text, maps in zip(b.column("text").to_pylist(), b.column(held).to_pylist()):
                lines = (text or "").split("\n")
                found = None
                if maps:
                    tag = row_tag(text or "")
                    found = next((m["bitmap"] for m in maps if m["tag"] == tag), None)
                keep = unpack(found, len(lines))
                texts.append(text if keep.all() else "\n".join([x for x, k in zip(lines, keep) if k]))
                total.append(len(lines))
                gone.append(int(len(lines) - keep.sum()))
            own = {"text": pa.array(texts, pa.string())}
            return pa.RecordBatch.from_arrays([own.get(c, b.column(c)) for c in columns] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

        return one

    return arrow_map(joined, [*columns, held], make, f"{schema}, n_lines long, n_dropped long")

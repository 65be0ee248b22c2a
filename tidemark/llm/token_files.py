"""Operator 1: token ids of whole documents in Parquet list columns.

``write_tokens`` range-partitions the documents by id, encodes each partition in
id order and writes one Parquet file per partition: ids as a dictionary-encoded list
(delta pages where the dictionary overflows), bounded row groups, and pages of bounded row count with
the column and offset indexes that let a reader fetch the metadata columns, or the
ids of a range of documents, without the rest. ``shard`` and ``local_start`` give each
document's place; ``token_starts`` turns them into corpus-wide offsets from one sum
per shard.

Defined cases: a null or empty text holds the end id alone; a null doc_id sorts first;
rows that repeat a doc_id stay, ordered by text; an empty table gives an empty store;
other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, gather, new_path, release_memory, split_words, text_batches, whole_texts

STORE_SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


#: Words, numbers, marks, letters of odd case and joining marks, for the probe below.
PROBE = "I'll don't 'S 's a1-b2, 3.14 x.\n\n  \u00c9t\u00e9 e \u0308x \u0130. \u03a3\u03a3, \u6f22\u5b57 \u0661\u0662 \U0001f600\u200d! \tq <|x|> \u00df--(y)"


class WordEncoder:
    """Ids of whole texts by a tokenizers file, with a memo of the chunks between blanks.

    Where no token of the file reaches over a blank or line end (a probe tells), a text's
    ids are those of its chunks in order. The library encodes each distinct chunk, many at
    a time: letters alone with blanks between, where it says that each made one word;
    others with a special token of the file between. A stop or comma at a chunk's end is
    encoded by itself where the library, asked for it with the character before it, gives
    the ids of both apart. For other files it encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        plain = lambda t: not (t.single_word or t.lstrip or t.rstrip or re.search(r"\s", t.content))
        self.chunked = all(map(plain, added.values())) and self._one(PROBE) == [i for c in re.split("[ \n]", PROBE) for i in self._one(c)]
        self.separator = next(((i, t.content) for i, t in added.items() if t.special and not t.normalized), None)
        self.marked = re.compile("[" + re.escape("".join({t.content[0] for t in added.values()})) + "]").search if added else lambda text: None
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max([*vocab.values(), *added], default=0), bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.bare = self._without_normalizer(path)
        self.memo: dict[str, bytes] = {"": b""}
        self.apart: dict[str, bool] = {}

    def _without_normalizer(self, path: str):
        """The same tokenizer for lower-case ASCII; None if its normaliser does more to ASCII than lower it."""
        from tokenizers import Tokenizer, normalizers

        printable = [chr(i) for i in range(33, 127)]
        probes = [a + b for a in ["", *printable] for b in printable]
        normalizer = self.tokenizer.normalizer
        if normalizer is None or any(normalizer.normalize_str(x) != x.lower() for x in probes):
            return None
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        return bare

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stands_apart(self, pair: str) -> bool:
        """Whether the library encodes a character and the mark after it as it does each alone."""
        known = self.apart.get(pair)
        if known is None:
            ids = self._one(pair)
            known = self.apart[pair] = bool(ids) and ids == self._one(pair[0]) + self._one(pair[1])
        return known

    def _joined(self, chunks: list[str], mark: str, together: int, cuts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tokenizer=None) -> list[str]:
        """Encodes chunks with ``mark`` between; ``cuts`` finds each one's ids. Returns those of groups that don't come apart."""
        left = []
        parts = [chunks[at : at + together] for at in range(0, len(chunks), together)]
        for part, e in zip(parts, (tokenizer or self.tokenizer).encode_batch_fast([mark.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts, ends = cuts(ids)
            if len(ends) != len(part) or len(ends) and ends[-1] != len(ids):
                left += part
                continue
            raw = ids.tobytes()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))))
        return left

    def _words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.ends[ids]) + 1
        return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends

    def _separated(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids == self.separator[0])
        return np.concatenate([[0], at + 1]), np.append(at, len(ids))

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks into the memo."""
        # every chunk of letters makes a word at least, so as many words as chunks are one each
        letters, ascii_, left = [], [], []
        for c in chunks:
            (left if not c.isalpha() else ascii_ if self.bare is not None and c.isascii() and c.islower() else letters).append(c)
        left += self._joined(letters, " ", 500, self._words) + self._joined(ascii_, " ", 500, self._words, self.bare)
        if self.separator is not None:
            mark = self.separator[1]
            odd = [c for c in left if mark in c]
            left = self._joined([c for c in left if mark not in c], mark, 2_000, self._separated) + odd
        self.memo.update(zip(left, self._each(left)))

    def _pieces(self, chunk: str) -> tuple[str, ...]:
        """What a chunk's ids are put together from; one that may hold a special token stays as it is."""
        if self.marked(chunk):
            return (chunk,)
        cut = chunk[-1] in ".," and len(chunk) > 1 and self._stands_apart(chunk[-2:])
        if self.bare is not None and chunk.isascii() and chunk.isprintable():
            chunk = chunk.lower()
        return (chunk[:-1], chunk[-1]) if cut else (chunk,)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text ends in them."""
        if not self.chunked:
            found = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int64)
        words, numbers, ends = split_words(pc.replace_substring(texts, "\n", " "))
        memo = self.memo
        found = list(map(memo.get, words))
        new = [w for w, f in zip(words, found) if f is None]
        pieces = list(map(self._pieces, new))
        self._learn([c for c in dict.fromkeys(chain.from_iterable(pieces)) if c not in memo])
        memo.update((w, memo[p[0]] if len(p) == 1 else memo[p[0]] + memo[p[1]]) for w, p in zip(new, pieces))
        found = [memo[w] if f is None else f for w, f in zip(words, found)]
        if len(memo) > 3 * MEMO_ENTRIES // 4:  # the words of this batch are the likeliest in the next
            self.memo = dict(zip(words, found)) | {"": b""}
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = gather(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[numbers], sizes[numbers])
        return ids, np.concatenate([[0], np.cumsum(sizes[numbers])])[ends]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker, so its memo serves the worker's later tasks too."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, row_group_rows: int = 20_000, page_rows: int = 1_000) -> str:
    """Encode ``docs`` (doc_id, text) into Parquet at ``path``, in ascending doc_id order."""
    path = path or new_path(docs.sparkSession, "tokens")

    def encode(batches):
        encoder, shard, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for b in text_batches(batches, 6 << 20):
            ids, ends = encoder.encode(whole_texts(b.column("text")))
            values = pa.array(np.insert(ids, ends[1:], end_id).view(np.int32))
            offsets = ends + np.arange(len(ends))
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                names=["doc_id", "shard", "local_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])
        release_memory()

    (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(encode, STORE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.row.count.limit", str(row_group_rows))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def token_starts(store: DataFrame) -> DataFrame:
    """shard, base: ids in all shards before it, from the metadata columns alone.

    The running sum is over one row per shard.
    """
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def with_starts(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``start`` to ``rows`` of a store: the ids of all documents before each."""
    placed = rows.join(token_starts(store), "shard")
    return placed.withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def id_checksums(store: DataFrame) -> DataFrame:
    """doc_id, shard, local_start, n_tokens, ids_crc32 of a token store."""

    def crc(batches):
        for b in batches:
            lists = b.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "shard", "local_start", "n_tokens")] + [pa.array([zlib.crc32(values[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], pa.int64())],
                names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
            )

    return store.mapInArrow(crc, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")

"""Operator 11: collocations from position bitmaps.

Texts of one language are laid end to end in shards of bounded size, with an empty
position between pieces. In a shard each word has a bitmap of its positions, of which
only the blocks that hold a bit are kept. A phrase's bitmap, shifted by one and ANDed
with a word's, is the bitmap of the phrase with that word after it; its bits are counted.
Prefixes are taken depth-first, a run of them at a time, so a shard's memory is bounded.
Local counts are summed over all shards.

What can't reach ``least`` occurrences isn't extended: filters of bounded size say which
words, pairs and triples of words may. That of words comes from exact counts, the others
from counters in which all texts' pairs (then triples) are summed by hash, so that none
that reaches ``least`` is left out. False bits cost work and change no result: exact sums
of the counts decide at last. Hashes serve the filters alone; counts go by text.

Defined cases: a null text is empty; a null lang is ``und``; rows count each, repeated or
not, whatever their doc_id; other columns are ignored; without a phrase of ``least``
occurrences, or without rows, the result is empty. Scores are exact up to products of
10^38, beyond which the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, release_memory, split_words, stored, text_batches, whole_texts
from .near_dedup import mix

#: Marks the end of a piece; not a character of any word.
END = "."
BITS = 16
NO_LANG = "und"


@dataclass(frozen=True)
class PhraseSpec:
    longest: int = 5
    least: int = 100
    best: int = 2_000
    shard: int = 1 << 20
    run: int = 1 << 17
    filter_bits: int = 1 << 26
    cells: int = 1 << 23
    #: Splits of the input whose counts are combined before they are shuffled.
    splits_a_task: int = 8


def _pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts (``END`` for ends of pieces), their numbers in order, and each text's end."""
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\x0A-\x0D]+", f" {END} ")
    return split_words(cut, None)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """Batches as a language, its distinct words, and the numbers of the words in order, with an end of piece after each text."""
    for b in text_batches(batches):
        lang = pc.fill_null(b.column("lang"), NO_LANG)
        for name in pc.unique(lang).to_pylist():
            texts = whole_texts(b.column("text").filter(pc.equal(lang, name)))
            ended = pc.binary_join_element_wise(texts, pa.scalar(f"{END}", pa.large_string()), pa.scalar("", pa.large_string()))
            words, numbers, _ = _pieces(ended)
            yield name, words, numbers


def _combined(docs: DataFrame, spec: PhraseSpec) -> DataFrame:
    """lang and text in fewer, larger tasks: each sends a phrase's count once, however many texts it has read."""
    rows = docs.select("lang", "text")
    splits = rows.rdd.getNumPartitions()
    return rows.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-splits // spec.splits_a_task)))


def _counted(lang: str, held: dict[str, int], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["lang", name, "f"])


def word_counts(docs: DataFrame, spec: PhraseSpec) -> DataFrame:
    """lang, word, f: occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        for lang, words, numbers in _by_lang(batches):
            held = sums.setdefault(lang, {})
            for w, c in zip(words, np.bincount(numbers, minlength=len(words)).tolist()):
                if w != END:
                    held[w] = held.get(w, 0) + c
            if sum(map(len, sums.values())) > MEMO_ENTRIES:
                for name in list(sums):
                    yield _counted(name, sums.pop(name), "word")
        for name in list(sums):
            yield _counted(name, sums.pop(name), "word")
        release_memory()

    counted = _combined(docs, spec).mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_hash(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def longer_hash(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + word)


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit array with a bit for each value of ``h``: at most ``bits`` / 8 bytes, whatever the table."""
    at = F.pmod(F.col("h"), F.lit(bits)) + 1  # the functions number bits from 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("part"))
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in rows.collect():
        start = (r["bucket"] - 1) * 4096
        out[start : start + len(r["part"])] = np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def in_filter(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes.view(np.int64) % bits).astype(np.int64)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Shard:
    """Positions of one language's words as compressed bitmaps: word, block and mask, a row for each block that a word is in."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, run: int = 1 << 17):
        """``numbers``: the word at each position, negative where there is none to look for; words are told by ``hashes``.

        ``run``: rows that are extended at a time.
        """
        self.hashes, self.size, self.run = hashes, len(numbers), run
        self.linked: list[np.ndarray] = []
        at = np.flatnonzero(numbers >= 0)
        word, block, bit = numbers[at].astype(np.int64), at // BITS, np.left_shift(np.uint16(1), (at % BITS).astype(np.uint16))
        key = block * max(1, len(hashes)) + word
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.mask = np.bitwise_or.reduceat(bit[order], first) if len(first) else np.empty(0, np.uint16)
        self.word, self.block = word[order][first], block[order][first]
        self.starts = np.searchsorted(self.block, np.arange(self.size // BITS + 3))

    def link(self, filters: list[np.ndarray], bits: int) -> None:
        """From now on extend phrases of 1, 2 ... words only to positions whose word ends a run of 2, 3 ... that the filters hold; the last filter serves longer phrases too."""
        numbers = np.full(self.size + BITS, -1)
        for i in range(BITS):
            held = np.flatnonzero(self.mask >> np.uint16(i) & 1)
            numbers[self.block[held] * BITS + i] = self.word[held]
        ends = np.flatnonzero(numbers >= 0)
        run = self.hashes[numbers[ends]]
        for filter_ in filters:
            on = numbers[ends + 1] >= 0
            ends, run = ends[on] + 1, longer_hash(run[on], self.hashes[numbers[ends[on] + 1]])
            kept = in_filter(filter_, run, bits)
            ends, run = ends[kept], run[kept]
            linked = np.zeros(self.size // BITS + 2, np.uint16)
            np.bitwise_or.at(linked, ends // BITS, np.left_shift(np.uint16(1), (ends % BITS).astype(np.uint16)))
            self.linked.append(linked)

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words' own bitmaps, a run of words at a time: word, block, mask."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        at = 0
        while at < len(order):
            end = min(len(order), at + self.run)
            end = int(np.searchsorted(word, word[end - 1], side="right"))  # whole words
            own = order[at:end]
            yield self.word[own], self.block[own], self.mask[own]
            at = end

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of phrases of ``length`` words, shifted by one and ANDed with those of the words in the blocks they reach: phrase, word, block, mask where a bit is left."""
        over = mask >> np.uint16(BITS - 1) > 0  # the bit that passes into the next block
        phrase, block, mask = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([mask << np.uint16(1), np.ones(int(over.sum()), np.uint16)])
        if self.linked:
            mask = mask & self.linked[min(length, len(self.linked)) - 1][block]
        some = mask > 0
        phrase, block, mask = phrase[some], block[some], mask[some]
        start, count = self.starts[block], self.starts[block + 1] - self.starts[block]
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a in range(0, len(phrase), self.run):
            s, c = start[a : a + self.run], count[a : a + self.run]
            row = np.repeat(np.arange(a, a + len(s)), c)
            at = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(s, c)
            both = mask[row] & self.mask[at]
            left = np.flatnonzero(both)
            for out, part in zip(found, (phrase[row[left]], self.word[at[left]], block[row[left]], both[left])):
                out.append(part)
        return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of two words or more as rows of word numbers, and their counts: each run of first words to its full depth."""
        for word, block, mask in self.roots():
            names = np.arange(len(self.hashes))[:, None]  # a row of words for each phrase number
            phrase = word
            for length in range(1, longest):
                before, after, block, mask = self.extended(phrase, block, mask, length)
                if not len(before):
                    break
                own, phrase = np.unique(before * len(self.hashes) + after, return_inverse=True)
                names = np.concatenate([names[own // len(self.hashes)], (own % len(self.hashes))[:, None]], axis=1)
                yield names, np.bincount(phrase, weights=np.bitwise_count(mask)).astype(np.int64)

    def hash_counts(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of phrases of just ``length`` words, and their counts."""
        for names, count in self.phrases(length):
            if names.shape[1] == length:
                run = self.hashes[names[:, 0]]
                for i in range(1, length):
                    run = longer_hash(run, self.hashes[names[:, i]])
                yield run, count


def _shards(batches: Iterator[pa.RecordBatch], filter_: np.ndarray, spec: PhraseSpec) -> Iterator[tuple[str, list[str], Shard]]:
    """Shards of one task's texts by language: its words that may be frequent, and their bitmaps."""
    held: dict[str, tuple[dict[str, int], list[np.ndarray], list[int]]] = {}

    def made(lang: str) -> tuple[str, list[str], Shard]:
        names, parts, _ = held.pop(lang)
        words = list(names)
        return lang, words, Shard(word_hash(lang, words), np.concatenate(parts), spec.run)

    for lang, words, numbers in _by_lang(batches):
        names, parts, size = held.setdefault(lang, ({}, [], [0]))
        maybe = in_filter(filter_, word_hash(lang, words), spec.filter_bits)
        own = np.array([names.setdefault(w, len(names)) if m and w != END else -1 for w, m in zip(words, maybe.tolist())], np.int64)
        parts.append(own[numbers])
        size[0] += len(numbers)
        if size[0] >= spec.shard:
            yield made(lang)
    for lang in list(held):
        yield made(lang)


def run_filter(docs: DataFrame, filters: list[np.ndarray], spec: PhraseSpec, block: int = 1 << 15) -> np.ndarray:
    """A bit for each of ``cells`` counters in which the runs of words of one length more than the filters' reach ``least`` together.

    The first filter is of words. A task sends its counters, cut off at ``least``, whatever it has read; the driver gets the bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    least, cells = spec.least, spec.cells
    kind = np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, kind)
        for _, _, shard in _shards(batches, shared.value[0], spec):
            shard.link(shared.value[1:], cells)
            for hashes, found in shard.hash_counts(len(shared.value) + 1):
                own, at = np.unique(hashes.view(np.int64) % cells, return_inverse=True)
                total[own] = np.minimum(least, total[own] + np.bincount(at, weights=found)).astype(kind)
        for at in range(0, cells, block):
            if (part := total[at : at + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])
        release_memory()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column("block").to_pylist(), b.column("part").to_pylist()):
                own = np.frombuffer(part, kind)
                held[at] = np.minimum(least, held[at] + own.astype(np.int64)) if at in held else own.astype(np.int64)
        bits = [np.packbits(v >= least, bitorder="little").tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(bits, pa.binary())], names=["block", "part"])

    parts = _combined(docs, spec).mapInArrow(count, "block long, part binary").repartition("block").mapInArrow(reach, "block long, part binary")
    out = np.zeros(-(-cells // 8), np.uint8)
    for r in parts.collect():
        own = np.frombuffer(r["part"], np.uint8)
        out[r["block"] // 8 : r["block"] // 8 + len(own)] = own
    return out


def phrase_counts(docs: DataFrame, filters: list[np.ndarray], spec: PhraseSpec) -> DataFrame:
    """lang, phrase, f: occurrences of phrases of 2 to ``longest`` words whose runs of words the filters hold."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        for lang, names, shard in _shards(batches, shared.value[0], spec):
            shard.link(shared.value[1:], spec.cells)
            texts, held = pa.array(names, pa.string()), sums.setdefault(lang, {})
            for words, count in shard.phrases(spec.longest):
                for at in range(0, len(words), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    phrase = pc.binary_join_element_wise(*(texts.take(pa.array(part[:, i])) for i in range(part.shape[1])), " ")
                    for p, c in zip(phrase.to_pylist(), count[at : at + (1 << 16)].tolist()):
                        held[p] = held.get(p, 0) + c
                    if len(held) > MEMO_ENTRIES // 2:
                        yield _counted(lang, held, "phrase")
                        held.clear()
        for lang, held in sums.items():
            yield _counted(lang, held, "phrase")
        release_memory()

    return _combined(docs, spec).mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of 2 to ``longest`` words.

    A phrase's score is that of its lowest-scoring cut, floor(1000 a n / (l r)). Phrases
    that are never seen but inside one longer candidate are left out: a longer one with as
    many occurrences has one that is longer by a single word between them.
    """
    counted = stored(word_counts(docs, spec), "word-counts")
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.where(F.col("f") >= spec.least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            h = [word_hash(lang, [w]).view(np.int64)[0] for lang, w in zip(langs, b.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["h"])

    word_filter = bit_filter(words.select("lang", "word").mapInArrow(hashed, "h long"), spec.filter_bits)
    filters = [word_filter]
    for _ in range(min(2, spec.longest - 1)):
        filters.append(run_filter(docs, filters, spec))
    found = stored(phrase_counts(docs, filters, spec).where(F.col("f") >= spec.least), "phrases")
    return best_phrases(found, stored(words, "words"), total, spec)


def best_phrases(found: DataFrame, words: DataFrame, total: DataFrame, spec: PhraseSpec) -> DataFrame:
    """Candidates scored by their lowest cut, without those a longer one holds, ranked in each language."""
    split = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inner = split.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = split.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = alone.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    parts = words.select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", F.col("phrase").alias("part"), "f"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    whole = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r", "n")}
    scored = cuts.withColumns(whole).withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * a * n) div (l * r)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of each of its parts, so no task sorts a language
    parts_of = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = lowest.withColumn("_part", parts_of).withColumn("_in_part", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_in_part") <= spec.best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= spec.best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))

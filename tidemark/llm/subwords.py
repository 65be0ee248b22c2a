"""Words of whole texts and their hashed features, a batch at a time and without a loop over words.

A word is a run without ASCII white space. Words are told apart by 64-bit hashes of their
spelling; what a model knows of a word is worked out once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import gather

#: Code points worked on at once.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def spelling_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``codes``."""
    places, out = _places(), np.zeros(len(starts), np.uint64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], BLOCK)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = total[a:b] - total[a]
        own = gather(codes, starts[a:b], lengths[a:b]).astype(np.uint64)
        own *= places[(np.arange(len(own)) - np.repeat(at, lengths[a:b])) & 4095]
        some = lengths[a:b] > 0
        out[a:b][some] = np.add.reduceat(own, at[some]) if some.any() else 0
        out[a:b] += lengths[a:b].astype(np.uint64)
    return mix(out)


@dataclass
class Words:
    """All words of a batch, in order.

    ``start`` and ``end`` are places in ``codes``, ``text_at`` where each text begins there,
    ``ends`` the words before each text (one more entry than texts), ``number`` the
    word's among the distinct ones, ``first`` an occurrence of each of these, ``keys``
    their hashes, ``closes`` whether a line ends between the word and the next.
    """

    codes: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray
    number: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    closes: np.ndarray

    def __len__(self) -> int:
        return len(self.number)

    def spelt(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words as ``<word>``, code points one after the other, and each one's length with the marks."""
        start = self.start[self.first] if start is None else start
        end = self.end[self.first] if end is None else end
        size = end - start
        out = np.empty(int(size.sum()) + 2 * len(size), np.uint32)
        at = np.cumsum(size + 2) - size - 2
        inside = np.ones(len(out), bool)
        inside[at], inside[at + size + 1] = False, False
        out[at], out[at + size + 1] = ord("<"), ord(">")
        out[inside] = gather(self.codes, start, size)
        return out, size + 2


def read_words(texts: pa.Array) -> Words:
    """The words of large strings without nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    if len(raw) and int(raw.max()) > 127:
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        text_at = heads[bounds]
    else:
        codes, text_at = raw.astype(np.uint32), bounds
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    opens, shuts = np.ones(len(codes), bool), np.ones(len(codes), bool)  # a blank or another text beside it
    opens[1:], shuts[:-1] = blank[:-1], blank[1:]
    opens[text_at[text_at < len(codes)]] = True
    shuts[text_at[text_at > 0] - 1] = True
    start, end = np.flatnonzero(opens & ~blank), np.flatnonzero(shuts & ~blank) + 1
    ends = np.searchsorted(start, text_at)
    keys = spelling_hashes(codes, start, end - start)
    number, distinct = pd.factorize(keys)
    first = np.zeros(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    lines = np.flatnonzero(codes == 10)
    before = np.searchsorted(lines, start)
    closes = np.ones(len(start), bool)
    closes[:-1] = before[1:] != before[:-1]
    last = ends[1:][np.diff(ends) > 0] - 1
    closes[last] = True
    return Words(codes, text_at, start, end, ends, number, first, np.asarray(distinct, np.uint64), closes)


def grams(spelt: np.ndarray, sizes: np.ndarray, low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: whether an n-gram of a word that isn't empty begins at each place, and its bucket."""
    ends = np.cumsum(sizes)
    left = (np.repeat(ends, sizes) - np.arange(len(spelt))).astype(np.int32)
    left[np.repeat(sizes <= 2, sizes)] = 0
    h = np.zeros(len(spelt), np.uint64)
    for k in range(min(high, len(h))):
        h[: len(h) - k] = h[: len(h) - k] * np.uint64(0x100000001B3) + spelt[k:] + np.uint64(1)
        if k + 1 >= low:
            yield left > k, bucket_of(h + np.uint64(k), buckets)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash; ``buckets`` is a power of two."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def word_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each word, one value a code point of what ``spelt`` gave."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the slices that ``ends`` marks, empty ones 0."""
    size = np.diff(ends)
    return np.bincount(np.repeat(np.arange(len(size)), size), values, len(size))


def distinct_pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (a, b), b under ``n``, in order, and how often each occurs."""
    key = np.sort(a.astype(np.int64) * max(1, n) + b)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // max(1, n), key[at] % max(1, n), np.diff(np.append(at, len(key)))

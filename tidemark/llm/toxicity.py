"""Operator 5: toxicity by multiple-instance learning.

Only documents carry labels. A sentence's score is a logistic function of its words'
weights (hashed words and character n-grams); a document's is the noisy-or of its
sentences. Gradient descent on the documents' likelihood trains the word weights, and
the sentences that score 0.5 or more by themselves locate what is offensive.

The model is fitted on a bounded sample of labelled rows (``MilSpec.positives`` and
``negatives``, by a hash of the id) in one task; scoring covers all rows in one pass
without a shuffle. Sample rows that a first fit leaves out choose the margin that a
document's log odds are lowered by; the model then learns from the whole sample.

Defined cases: null labels and ids are no training rows; null and empty texts score as
one empty sentence and locate nothing; without a label of either kind every sentence
scores the prior; rows that repeat stay; an empty table gives an empty result; a kept
column may have any name but score, predicted and offending.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checked_keep, fit_on_sample, label_sample, whole_texts
from .subwords import Words, bucket_of, distinct_pairs, grams, read_words, spelling_hashes, sums, word_sums

STOPS = ".!?"
EDGES = ".,!?;:\"'()[]{}*#$%&|-"


@dataclass(frozen=True)
class MilSpec:
    positives: int = 1_500
    negatives: int = 4_000
    buckets: int = 1 << 18
    low: int = 4
    high: int = 6
    least_documents: int = 2
    rounds: int = 60
    rate: float = 0.25
    sparsity: float = 0.005
    bias: float = -6.0
    #: One sample row in so many is held back to choose the margin.
    held_back: int = 5


@dataclass(frozen=True, eq=False)
class MilModel:
    """``margin``: what the log odds of a document are lowered by."""

    spec: MilSpec
    weights: np.ndarray
    bias: float
    margin: float = 0.0


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The lower-case letter of each code point of the first plane, where it is a single one."""
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)


def _one_of(codes: np.ndarray, marks: str) -> np.ndarray:
    """Which code points are among these ASCII marks."""
    held = np.zeros(129, bool)
    held[[ord(c) for c in marks]] = True
    return held[np.minimum(codes, 128)]


def _spelt(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in lower case without marks at their edges: spelling, sizes and hash."""
    start, end = words.start[words.first], words.end[words.first]
    edge = _one_of(words.codes, EDGES)
    at = np.arange(len(edge), dtype=np.int32 if len(edge) < 1 << 31 else np.int64)
    right = np.minimum.accumulate(np.where(edge, len(edge), at)[::-1])[::-1]
    left = np.maximum.accumulate(np.where(edge, -1, at))
    if len(start):
        start = np.minimum(right[start], end)
        end = np.maximum(left[end - 1] + 1, start)
    spelt, sizes = words.spelt(start, end)
    low = _lower()
    first_plane = spelt < len(low)
    spelt[first_plane] = low[spelt[first_plane]]
    return spelt, sizes, spelling_hashes(spelt, np.cumsum(sizes) - sizes, sizes)


def _shares(sizes: np.ndarray, spec: MilSpec) -> np.ndarray:
    """What an n-gram of a word counts: one by the root of their number in it."""
    count = sum(np.maximum(0, sizes - k) for k in range(spec.low - 1, spec.high))
    return (1 / np.sqrt(np.maximum(1, count))).astype(np.float32)


def _features(words: Words, chosen: np.ndarray, spec: MilSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, bucket and share of each feature of the chosen distinct words: a whole word counts in full."""
    spelt, sizes, keys = _spelt(words)
    wanted = np.zeros(len(sizes), bool)
    wanted[chosen] = True
    some = np.flatnonzero(wanted & (sizes > 2))
    owner_of = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
    wanted = wanted[owner_of]
    share = _shares(sizes, spec)
    owners, found, shares = [some.astype(np.int32)], [bucket_of(keys[some], spec.buckets)], [np.ones(len(some), np.float32)]
    for here, bucket in grams(spelt, sizes, spec.low, spec.high, spec.buckets):
        at = np.flatnonzero(here & wanted)
        owners.append(owner_of[at])
        found.append(bucket[at])
        shares.append(share[owner_of[at]])
    return np.concatenate(owners), np.concatenate(found), np.concatenate(shares)


def _sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ends of sentences among the words, and ends of documents among the sentences.

    A stop at the end of a word, a line end and the document's end close a sentence; a
    document without a word is one empty sentence.
    """
    at = np.flatnonzero(words.closes | _one_of(words.codes[words.end - 1], STOPS)) + 1
    per_doc = np.diff(np.searchsorted(at, words.ends, "right"))
    empty = np.diff(words.ends) == 0
    own = np.sort(np.concatenate([at, words.ends[1:][empty]]))
    return np.concatenate([[0], own]), np.concatenate([[0], np.cumsum(np.where(empty, 1, per_doc))])


def _pairs(words: Words, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's distinct words: the sentence and the word's number."""
    sentence = np.repeat(np.arange(len(sentence_ends) - 1), np.diff(sentence_ends))
    return distinct_pairs(sentence, words.number, len(words.first))[:2]


def _learn(words: Words, y: np.ndarray, spec: MilSpec) -> MilModel:
    """Adam on the noisy-or likelihood, all documents a round.

    Weights stay at 0 or more and shrink a little each round: a sentence offends by what
    it holds, and no number of plain words makes up for it. Words of fewer than
    ``least_documents`` documents teach nothing.
    """
    weights, bias, n_words = np.zeros(spec.buckets), spec.bias, len(words.first)
    doc, number, _ = distinct_pairs(np.repeat(np.arange(len(y)), np.diff(words.ends)), words.number, n_words)
    common = np.bincount(number, minlength=n_words) >= spec.least_documents
    owner, bucket, share = _features(words, np.flatnonzero(common), spec)
    # a bucket that no toxic document has keeps weight 0, so it takes no part in a round
    bad = np.zeros(n_words, bool)
    bad[number[y[doc]]] = True
    open_ = np.zeros(spec.buckets, bool)
    open_[bucket[bad[owner]]] = True
    some = open_[bucket]
    owner, bucket, share = owner[some], bucket[some], share[some].astype(np.float64)
    common, owner = np.unique(owner, return_inverse=True)
    rank = np.full(n_words, -1)
    rank[common] = np.arange(len(common))
    used, bucket = np.unique(bucket, return_inverse=True)
    sentence_ends, doc_ends = _sentences(words)
    sentence_of, number = _pairs(words, sentence_ends)
    known = rank[number] >= 0
    sentence_of, number = sentence_of[known], rank[number[known]]
    doc_of = np.repeat(np.arange(len(y)), np.diff(doc_ends))
    own, m, v = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, spec.rounds + 1):
        word_score = np.bincount(owner, own[bucket] * share, len(common))
        z = bias + np.bincount(sentence_of, word_score[number], len(sentence_ends) - 1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc_of, -np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # -log P(no sentence)
        blame = np.where(y, -np.exp(-none) / np.maximum(1e-6, -np.expm1(-none)), 1.0)
        dz = p * blame[doc_of]
        dword = np.bincount(number, dz[sentence_of], len(common))
        grad = np.append(np.bincount(bucket, dword[owner] * share, len(used)), dz.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = spec.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        own = np.maximum(0, own - step[:-1] - spec.rate * spec.sparsity)
        bias -= step[-1]
    weights[used] = own
    return MilModel(spec, weights.astype(np.float32), float(bias))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return np.log(p) - np.log1p(-p)


def best_margin(odds: np.ndarray, y: np.ndarray, spread: float = 2.0) -> float:
    """The shift of the log odds that makes the labels likeliest, itself drawn from a normal around 0 with deviation ``spread``, so that few rows move it little."""
    cuts = np.linspace(-8, 8, 321)
    cost = [np.logaddexp(0, np.where(y, c - odds, odds - c)).sum() + c * c / (2 * spread**2) for c in cuts]
    return float(cuts[np.argmin(cost)])


def fit(texts: list[str], labels: list[int], spec: MilSpec = MilSpec()) -> MilModel:
    """Learn from the sample; the margin comes from rows of the sample that a first fit leaves out."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return MilModel(spec, np.zeros(spec.buckets, np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    column = pa.array(texts, pa.large_string())
    back = np.zeros(len(y), bool)
    for label in (False, True):  # every so-manieth row of each label
        back[np.flatnonzero(y == label)[spec.held_back - 1 :: spec.held_back]] = True
    margin = 0.0
    if back.any() and 0 < y[~back].sum() < (~back).sum():
        first = Scorer(_learn(read_words(column.filter(pa.array(~back))), y[~back], spec))
        margin = best_margin(log_odds(first.documents(read_words(column.filter(pa.array(back))))), y[back])
    return replace(_learn(read_words(column), y, spec), margin=margin)


class Scorer:
    def __init__(self, model: MilModel):
        self.model = model

    def _sentence_odds(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each sentence, ends of sentences and ends of documents."""
        spec, weights = self.model.spec, self.model.weights
        spelt, sizes, keys = _spelt(words)
        part = np.zeros(len(spelt), np.float32)
        for here, bucket in grams(spelt, sizes, spec.low, spec.high, spec.buckets):
            part += np.where(here, weights[bucket], np.float32(0))
        score = word_sums(part, sizes) * _shares(sizes, spec) + np.where(sizes > 2, weights[bucket_of(keys, spec.buckets)], 0)
        sentence_ends, doc_ends = _sentences(words)
        sentence, number = _pairs(words, sentence_ends)
        return self.model.bias + np.bincount(sentence, score[number], len(sentence_ends) - 1), sentence_ends, doc_ends

    def documents(self, words: Words) -> np.ndarray:
        """The noisy-or of each text's sentences."""
        odds, _, doc_ends = self._sentence_odds(words)
        return -np.expm1(-sums(np.logaddexp(0, odds), doc_ends))

    def scores(self, words: Words) -> np.ndarray:
        """The noisy-or with its log odds lowered by the margin."""
        return self._moved(self.documents(words))

    def _moved(self, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(log_odds(p) - self.model.margin, -60, 60)))

    def located(self, words: Words, least: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and for texts of ``least`` or more start, end (characters) and score of each sentence that has as much by itself."""
        odds, sentence_ends, doc_ends = self._sentence_odds(words)
        p = self._moved(-np.expm1(-sums(np.logaddexp(0, odds), doc_ends)))
        alone = self._moved(1 / (1 + np.exp(-np.clip(odds, -60, 60))))
        out: list[list[dict]] = [[] for _ in p]
        for d in np.flatnonzero(p >= least):
            for s in range(doc_ends[d], doc_ends[d + 1]):
                a, b = sentence_ends[s], sentence_ends[s + 1]
                if alone[s] >= least and a < b:
                    out[d].append({"start": int(words.start[a] - words.text_at[d]), "end": int(words.end[b - 1] - words.text_at[d]), "p": float(alone[s])})
        return p, out


@lru_cache(maxsize=2)
def scorer_of(model: MilModel) -> Scorer:
    """One scorer a Python worker and model."""
    return Scorer(model)


def train(docs: DataFrame, labels: DataFrame, where: Column, spec: MilSpec = MilSpec()) -> MilModel:
    """Fit on at most ``positives + negatives`` labelled rows that satisfy ``where`` (a condition on doc_id)."""
    chosen = label_sample(labels.select("doc_id", "toxic"), "toxic", where, {1: spec.positives, 0: spec.negatives})
    return fit_on_sample(docs, chosen, spec.positives + spec.negatives, lambda texts, labels: fit(texts, labels, spec))


def score(docs: DataFrame, model: MilModel, keep: list[str] = ["doc_id"], least: float = 0.5) -> DataFrame:
    """``keep`` columns, score, predicted and the offending sentences of documents scored ``least`` or more."""
    checked_keep(keep, "score", "predicted", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = scorer_of(shared.value)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())]))

        def one(b):
            p, found = scorer.located(read_words(whole_texts(b.column("text"))), least)
            return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(p), pa.array(p >= least).cast(pa.int32()), pa.array(found, spans)], names=[*keep, "score", "predicted", "offending"])

        return one

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    columns = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(docs, columns, make, f"{kept}, score double, predicted int, offending array<struct<start: int, end: int, p: float>>")

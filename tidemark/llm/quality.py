"""Operator 6: a quality classifier on supervised subword embeddings.

Words (case kept), their character n-grams and pairs of neighbouring words have hashed
vectors; a word that repeats the one before it has one vector more, the same for all
words. A document is the average of its vectors, a softmax over the classes gives its
score, and minibatch stochastic gradient descent in numpy learns vectors and output
together.

The model is fitted on a bounded sample of labelled rows (``EmbeddingSpec.good`` and
``poor``, by a hash of the id) in one task. As the output is linear in the average,
a word's part of the logit is one number, so scoring is one pass without a shuffle.

Defined cases: null labels and ids are no training rows; null and empty texts score as
the zero vector; without a label of either kind every score is that of the prior; rows
that repeat stay; an empty table gives an empty result; a kept column may have any name
but score and predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import arrow_map, checked_keep, fit_on_sample, label_sample, whole_texts
from .subwords import Words, bucket_of, distinct_pairs, grams, mix, read_words, sums, word_sums


@dataclass(frozen=True)
class EmbeddingSpec:
    good: int = 2_000
    poor: int = 1_200
    buckets: int = 1 << 16
    pair_buckets: int = 1 << 16
    width: int = 8
    low: int = 2
    high: int = 4
    updates: int = 400
    batch: int = 64
    rate: float = 0.5
    seed: int = 7

    @property
    def rows(self) -> int:
        return self.buckets + self.pair_buckets + 1


@dataclass(frozen=True, eq=False)
class EmbeddingModel:
    """``vectors``: a row a bucket of words and n-grams, then of pairs, the last for a repeated word; ``out`` and ``bias``: logits of the labels."""

    spec: EmbeddingSpec
    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _neighbours(words: Words, spec: EmbeddingSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that have one before them in their text, the pair's vector, and whether the two are the same."""
    inner = np.ones(len(words), bool)
    inner[words.ends[:-1][words.ends[:-1] < len(words)]] = False
    at = np.flatnonzero(inner)
    left, right = words.keys[words.number[at - 1]], words.keys[words.number[at]]
    return at, spec.buckets + bucket_of(mix(left * np.uint64(3) + right), spec.pair_buckets), words.number[at] == words.number[at - 1]


def _documents(words: Words, spec: EmbeddingSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct vectors with their shares of its average, and where each document begins."""
    n = len(words.ends) - 1
    doc_of = np.repeat(np.arange(n), np.diff(words.ends))
    spelt, sizes = words.spelt()
    owner_of = np.repeat(np.arange(len(sizes)), sizes)
    doc, number, times = distinct_pairs(doc_of, words.number, len(sizes))
    docs, rows, counts = [doc], [bucket_of(words.keys[number], spec.buckets)], [times]
    first = np.searchsorted(number[(order := np.argsort(number, kind="stable"))], np.arange(len(sizes) + 1))
    for here, bucket in grams(spelt, sizes, spec.low, spec.high, spec.buckets):
        at = np.flatnonzero(here)
        owner = owner_of[at]
        reach = first[owner + 1] - first[owner]  # documents that hold the word
        row = np.repeat(bucket[at], reach)
        place = order[np.repeat(first[owner], reach) + np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)]
        docs.append(doc[place])
        rows.append(row)
        counts.append(times[place])
    at, pair, same = _neighbours(words, spec)
    docs += [doc_of[at], doc_of[at[same]]]
    rows += [pair, np.full(int(same.sum()), spec.rows - 1)]
    counts += [np.ones(len(at), int), np.ones(int(same.sum()), int)]
    docs, rows, counts = (np.concatenate(x) for x in (docs, rows, counts))
    key = docs.astype(np.int64) * spec.rows + rows
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    weight = np.add.reduceat(counts, new) if len(new) else np.empty(0)
    doc = key[new] // spec.rows
    total = np.bincount(doc, weight, n)
    return (key[new] % spec.rows).astype(np.int32), (weight / total[doc]).astype(np.float32), np.searchsorted(doc, np.arange(n + 1))


def fit(texts: list[str], labels: list[int], spec: EmbeddingSpec = EmbeddingSpec(), part: int = 200) -> EmbeddingModel:
    """AdaGrad on minibatches that are drawn once and come in a new order each round, as many updates for any sample."""
    y = np.array(labels, int)
    random = np.random.default_rng(spec.seed)
    vectors = (random.uniform(-1, 1, (spec.rows, spec.width)) / spec.width).astype(np.float32)
    out, bias = np.zeros((spec.width, 2)), np.zeros(2)
    if not len(y) or y.all() or not y.any():
        bias[:] = np.log([(y == 0).sum() + 0.5, (y == 1).sum() + 0.5])
        return EmbeddingModel(spec, np.zeros_like(vectors), out, bias)
    column, docs = pa.array(texts, pa.large_string()), []
    for at in range(0, len(y), part):
        feats, share, begins = _documents(read_words(column.slice(at, part)), spec)
        docs += [(feats[i:j], share[i:j]) for i, j in zip(begins[:-1], begins[1:])]
    order = random.permutation(len(y))
    batches = []
    for at in range(0, len(y), spec.batch):
        chosen = order[at : at + spec.batch]
        used, where = np.unique(np.concatenate([docs[i][0] for i in chosen]), return_inverse=True)
        sizes = [len(docs[i][0]) for i in chosen]
        batches.append((y[chosen], used, where.astype(np.int32), np.concatenate([docs[i][1] for i in chosen]), np.repeat(np.arange(len(chosen)), sizes).astype(np.int16)))
    del docs
    squares = np.full_like(vectors, 1e-6)  # AdaGrad's sums
    out_squares, bias_squares = np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    orders = (random.permutation(len(batches)) for _ in range(-(-spec.updates // len(batches))))
    for update, i in enumerate(islice(chain.from_iterable(orders), spec.updates)):
        rate = spec.rate * (1 - update / spec.updates)
        truth, used, where, share, owner = batches[i]
        shares = np.zeros((len(truth), len(used)), np.float32)
        shares[owner, where] = share
        hidden = shares @ vectors[used]
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True)
        g[np.arange(len(truth)), truth] -= 1
        g /= len(truth)
        back = (g @ out.T).astype(np.float32)
        grad = shares.T @ back
        squares[used] += grad * grad
        vectors[used] -= rate * grad / np.sqrt(squares[used])
        d_out, d_bias = hidden.T @ g, g.sum(axis=0)
        out_squares += d_out * d_out
        bias_squares += d_bias * d_bias
        out -= rate * d_out / np.sqrt(out_squares)
        bias -= rate * d_bias / np.sqrt(bias_squares)
    return EmbeddingModel(spec, vectors, out, bias)


class Scorer:
    def __init__(self, model: EmbeddingModel):
        self.spec = model.spec
        self.logits = (model.vectors.astype(np.float64) @ (model.out[:, 1] - model.out[:, 0])).astype(np.float32)
        self.bias = float(model.bias[1] - model.bias[0])

    def documents(self, words: Words) -> np.ndarray:
        spec, logits = self.spec, self.logits
        spelt, sizes = words.spelt()
        part, count = np.zeros(len(spelt), np.float32), np.ones(len(sizes), np.int64)
        for k, (here, bucket) in enumerate(grams(spelt, sizes, spec.low, spec.high, spec.buckets)):
            part += np.where(here, logits[bucket], np.float32(0))
            count += np.maximum(0, sizes - (spec.low + k - 1))
        score = word_sums(part, sizes) + logits[bucket_of(words.keys, spec.buckets)]
        at, pair, same = _neighbours(words, spec)
        own, size = score[words.number].astype(np.float64), count[words.number]
        own[at] += logits[pair] + same * logits[-1]
        size[at] += 1 + same
        return 1 / (1 + np.exp(-np.clip(sums(own, words.ends) / np.maximum(1, sums(size, words.ends)) + self.bias, -60, 60)))


@lru_cache(maxsize=2)
def scorer_of(model: EmbeddingModel) -> Scorer:
    """One scorer a Python worker and model."""
    return Scorer(model)


def train(docs: DataFrame, labels: DataFrame, where: Column, spec: EmbeddingSpec = EmbeddingSpec()) -> EmbeddingModel:
    """Fit on at most ``good + poor`` labelled rows that satisfy ``where`` (a condition on doc_id)."""
    chosen = label_sample(labels.select("doc_id", "quality"), "quality", where, {1: spec.good, 0: spec.poor})
    return fit_on_sample(docs, chosen, spec.good + spec.poor, lambda texts, labels: fit(texts, labels, spec))


def score(docs: DataFrame, model: EmbeddingModel, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, score (of label 1) and predicted."""
    checked_keep(keep, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = scorer_of(shared.value)

        def one(b):
            p = scorer.documents(read_words(whole_texts(b.column("text"))))
            return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(p), pa.array(p >= 0.5).cast(pa.int32())], names=[*keep, "score", "predicted"])

        return one

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return arrow_map(docs, list(dict.fromkeys([*keep, "text"])), make, f"{kept}, score double, predicted int")

"""Operator 7: soft-membership mixing to target weights.

A classifier fitted on a labelled table gives every document posteriors over domains.
A document of n tokens and posteriors p, taken at rate r, adds r * n * p_k tokens to
domain k in expectation. Nonnegative rates whose
expected totals match the targets are found by projected-gradient least squares from
equal rates: each step needs only the totals by domain and moves a document's rate by its
posteriors times the residual, projected to 0 or more. So the rate is a function of the
posteriors alone, and the steps run over cells of documents of nearly equal posteriors,
whose number has a bound (``MixSpec.grid``) that no corpus moves; Spark sums the cells
once, before its shuffle, and the totals of each step. Documents get their rates by
replaying the steps on their own posteriors, and the totals reached are measured on the
documents. Squares are weighed by the inverse of the domains' token-weighted Gram matrix,
so small domains count as large ones do, with Nesterov's momentum. Domains without a
target weight keep out of the fit.

Domains come from ``labels``: toxic, poor (quality 0) and good, in this order of
precedence. The classifier has two parts fitted on that table: multiple-instance
learning gives the toxic share, and subword embeddings split the rest into poor and
good; both fit on bounded samples (``MilSpec``, ``EmbeddingSpec``) and share one cutting
of a text into words. Tokens are counted as these words: the mix comes before any
tokenizer is chosen.

Defined cases: null and empty texts have no tokens and move no total; null labels are no
training rows; a target for a domain without tokens can't be met and leaves the others
met, and a warning names totals that miss their targets; rows that repeat count each; a
null doc_id is a document; an empty table gives an empty result; other columns are
ignored, and a kept column may have any name but n_tokens and p.
"""

from __future__ import annotations

import logging
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import arrow_map, checked_keep, stored, whole_texts
from .subwords import read_words

LOG = logging.getLogger(__name__)
DOMAINS = ("toxic", "poor", "good")


@dataclass(frozen=True)
class MixSpec:
    toxic: toxicity.MilSpec = toxicity.MilSpec()
    quality: quality.EmbeddingSpec = quality.EmbeddingSpec()
    steps: int = 60
    tolerance: float = 1e-4
    patience: int = 6
    #: Cells to a posterior's range of 1 on each axis: at most (grid + 1) ** 2 cells.
    grid: int = 512


@dataclass(frozen=True)
class DomainModel:
    toxic: toxicity.MilModel
    quality: quality.EmbeddingModel


class Classifier:
    def __init__(self, model: DomainModel):
        self.toxic, self.quality = toxicity.scorer_of(model.toxic), quality.scorer_of(model.quality)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """[n, domains], each row's sum 1, and the number of words of each text."""
        words = read_words(texts)  # cut once for both parts
        bad, good = self.toxic.scores(words), self.quality.documents(words)
        return np.stack([bad, (1 - bad) * (1 - good), (1 - bad) * good], axis=1), np.diff(words.ends)


def train(docs: DataFrame, labels: DataFrame, spec: MixSpec = MixSpec()) -> DomainModel:
    every = F.lit(True)
    return DomainModel(toxicity.train(docs, labels, every, spec.toxic), quality.train(docs, labels, every, spec.quality))


def posteriors(docs: DataFrame, model: DomainModel, keep: list[str] = ["doc_id"]) -> DataFrame:
    """``keep`` columns, n_tokens (words) and p, the posteriors in the order of DOMAINS."""
    checked_keep(keep, "n_tokens", "p")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        classifier = Classifier(shared.value)

        def one(b):
            p, size = classifier.posteriors(whole_texts(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(p.ravel()))
            return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(size.astype(np.int64)), lists], names=[*keep, "n_tokens", "p"])

        return one

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return arrow_map(docs, list(dict.fromkeys([*keep, "text"])), make, f"{kept}, n_tokens long, p array<double>")


def replay(p: np.ndarray, moves: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Rates after the moves so far, from 1: (residual scaled by the step, momentum) each."""
    rate = last = np.ones(len(p))
    for residual, momentum in moves:
        ahead = rate + momentum * (rate - last)
        last, rate = rate, np.maximum(0, ahead - p @ residual)
    return np.stack([last, rate], axis=1)


def _with_rates(rows: DataFrame, moves: list[tuple[np.ndarray, float]], keep: list[str], previous: bool = False) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))
            rate = replay(p, moves)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(rate[:, 1]), pa.array(rate[:, 0])], names=[*keep, "rate", "last"])

    out = rows.mapInArrow(run, f"{kept}, rate double, last double")
    return out if previous else out.drop("last")


def _totals(rated: DataFrame, rate: str) -> list:
    return [F.sum(F.col(rate) * F.col("n_tokens") * F.col("p")[k]).alias(f"{rate}{k}") for k in range(len(DOMAINS))]


def cells(rows: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """n_tokens and mean p of the documents in each cell of the posteriors; a bounded number of rows."""
    place = [F.floor(F.col("p")[k] * spec.grid).alias(f"c{k}") for k in range(len(DOMAINS) - 1)]
    sums_ = [F.sum(F.col("n_tokens") * F.col("p")[k]).alias(f"s{k}") for k in range(len(DOMAINS))]
    found = rows.where("n_tokens > 0").groupBy(*place).agg(F.sum("n_tokens").alias("n_tokens"), *sums_)
    return found.select("n_tokens", F.array(*[F.col(f"s{k}") / F.col("n_tokens") for k in range(len(DOMAINS))]).alias("p"))


def _sums(row) -> np.ndarray:
    return np.array([x or 0.0 for x in row])


def solve(rows: DataFrame, targets: np.ndarray, spec: MixSpec = MixSpec()) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """The moves that bring the expected totals to ``targets``, and the totals reached.

    ``rows``: n_tokens and p, cells or single documents, stored. One pass a step; the
    driver holds vectors of the number of domains. A NaN target leaves its domain free.
    Ends when the targets are met within ``tolerance``, or when ``patience`` steps have brought
    the totals no nearer by as much: some targets, such as 0, can't be met exactly.
    """
    k = len(DOMAINS)
    bound = ~np.isnan(targets)
    targets = np.where(bound, targets, 0.0)
    gram = _sums(rows.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}{j}") for i in range(k) for j in range(k)]).first())
    gram = gram.reshape(k, k)[np.ix_(bound, bound)]
    # residuals weigh by the inverse Gram matrix, which makes one the steepest safe step
    step = np.zeros((k, k))
    step[np.ix_(bound, bound)] = np.linalg.pinv(gram) if bound.any() else 0.0
    moves: list[tuple[np.ndarray, float]] = []
    t, momentum = 1.0, 0.0
    totals, nearest, since = np.zeros(k), np.inf, 0
    for _ in range(spec.steps):
        rated = _with_rates(rows, moves, ["n_tokens", "p"], previous=True)
        found = _sums(rated.agg(*_totals(rated, "rate"), *_totals(rated, "last")).first())
        totals, before = found[:k], found[k:]
        off = unmet(totals, np.where(bound, targets, np.nan))
        nearest, since = (off, 0) if off < nearest - spec.tolerance else (min(off, nearest), since + 1)
        if off <= spec.tolerance or since >= spec.patience and off <= nearest + spec.tolerance:
            break
        ahead = totals + momentum * (totals - before)  # totals are linear in the rates
        moves.append((step @ np.where(bound, ahead - targets, 0.0), momentum))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        t, momentum = after, (t - 1) / after
    LOG.info("rates after %d steps; totals are off by %.2g of the targets", len(moves), nearest)
    return moves, totals


def unmet(totals: np.ndarray, targets: np.ndarray) -> float:
    """How far totals are from their targets, as a share of all that is aimed at."""
    bound = ~np.isnan(targets)
    return float(np.abs(totals - targets)[bound].sum() / max(1.0, np.abs(targets[bound]).sum()))


def token_targets(rows: DataFrame, weights: dict[str, float], headroom: float = 1.0, whole: str | None = None) -> np.ndarray:
    """Target tokens by domain: the largest mix of these weights that needs no domain more than once, times ``headroom``; domains without a weight are free (NaN).

    With ``whole`` the mix is sized by that domain alone, so that it is there once; a
    domain too scarce for its share is then asked for once as well and binds nothing.
    """
    have = _sums(rows.agg(*[F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(DOMAINS))]).first())
    share = np.array([weights.get(d, np.nan) for d in DOMAINS], float)
    share /= max(1e-12, np.nansum(share))
    if whole is not None:
        k = DOMAINS.index(whole)
        return np.minimum(have, share * (have[k] / share[k])) * headroom
    wanted = np.nan_to_num(share) > 0
    budget = float((have[wanted] / share[wanted]).min()) if wanted.any() else 0.0
    return share * budget * headroom


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], headroom: float = 1.0, spec: MixSpec = MixSpec(), whole: str | None = None, least_met: float = 0.02) -> DataFrame:
    """doc_id, n_tokens, p, rate and copies: the rate rounded up or down by a hash of doc_id, right in expectation.

    Where the posteriors can't thin the other domains and keep ``whole``, the others are
    free. Totals of all documents at their rates that miss the targets by more than
    ``least_met`` of them are warned of.
    """
    rows = stored(posteriors(docs, train(docs, labels, spec)), "posteriors")
    binned = stored(cells(rows, spec), "cells")
    targets = token_targets(binned, weights, headroom, whole)
    moves, totals = solve(binned, targets, spec)
    if whole is not None:
        first = np.array([d == whole for d in DOMAINS])
        if (totals * headroom < targets * (1 - spec.tolerance))[first].any():
            targets = np.where(first, targets, np.nan)
            moves, _ = solve(binned, targets, spec)
    rated = _with_rates(rows, moves, ["doc_id", "n_tokens", "p"])
    reached = _sums(rated.agg(*_totals(rated, "rate")).first())
    if unmet(reached, targets) > least_met:
        warnings.warn(f"the mix reaches {dict(zip(DOMAINS, reached.round()))} tokens of targets {dict(zip(DOMAINS, targets.round()))}", stacklevel=2)
    chance = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))

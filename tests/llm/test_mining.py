"""Phrases, the n-gram join and hard negatives against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, near_dedup, ngram_join, phrases
from tidemark.llm.common import STORED, remove_stored, stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Phrases -----------------------------------------------------------------------------------


def brute_phrases(rows, longest, least, best):
    f: dict[str, Counter] = {}
    for lang, text in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        inside = {}
        for p, c in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(c, inside.get(p[i:j], 0))
        scored = []
        for p, a in found.items():
            if inside.get(p, 0) >= a:
                continue
            score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def found_phrases(df, spec):
    return sorted(tuple(r) for r in phrases.collocations(df, spec).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("shard", "run"), [(50, 7), (1 << 20, 1 << 17)])
def test_phrases_equal_brute_force(spark, shard, run):
    random = np.random.default_rng(3)
    words = ["a", "Bb", "ü", "ccc", "d\x00", "e'", "x-y", "ÀÀ", "long" * 20]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ; ", "!?", "\r\n", "\x0b"]
    weight = np.array([8, 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5]) / 14
    text = lambda n: "".join(words[random.choice(9, p=weight)] + ends[random.choice(10, p=[0.8] + [0.2 / 9] * 9)] for _ in range(n))
    rows = [([None, "en", "de", "und"][i % 4], text(int(random.integers(0, 60)))) for i in range(160)] + [("en", None), (None, None), ("en", ""), ("fr", " .. "), ("en", text(5000))]
    rows += [("de", "one Two three four five six. seven")] * 9
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "lang string, text string, phrase string, f double").repartition(5)
    for least, best in ((4, 1000), (3, 7)):
        spec = phrases.PhraseSpec(longest=5, least=least, best=best, shard=shard, run=run)
        want = brute_phrases(rows, 5, least, best)
        assert len(want) > 20
        assert found_phrases(df, spec) == want


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert found_phrases(df, phrases.PhraseSpec()) == []
    rare = spark.createDataFrame([("en", "a b c"), ("en", None)], "lang string, text string")
    assert found_phrases(rare, phrases.PhraseSpec()) == []


def test_scores_pass_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 10**12)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "a", 10**12 + 1), ("en", "b", 3 * 10**12)], "lang string, word string, f long")
    total = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    out = phrases.best_phrases(found, words, total, phrases.PhraseSpec()).collect()
    assert out[0]["score"] == 1000 * 10**12 * 10**14 // ((10**12 + 1) * 3 * 10**12)


def test_false_bits_change_nothing(spark):
    """Filters so small that every word and pair passes them."""
    rows = [("en", "p q r s. q r"), ("en", "r s t p q")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    for bits in (8, 1 << 20):
        assert found_phrases(df, phrases.PhraseSpec(least=3, filter_bits=bits, cells=bits)) == brute_phrases(rows, 5, 3, 2000)


# Joins by similarity -----------------------------------------------------------------------


def sets_of(texts, k):
    out = []
    for t in texts:
        words = [w for w in re.split("[ \t-\r]+", (t or "").translate(LOWER)) if w]
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    return out


def brute_components(ids, texts, k, percent):
    """Sizes of the sets and smallest ids reached, by one product of matrices."""
    sets = sets_of(texts, k)
    number: dict = {}
    cells = [(i, number.setdefault(g, len(number))) for i, s in enumerate(sets) for g in s]
    m = np.zeros((len(sets), max(1, len(number))), np.float32)
    m[tuple(np.array(cells).T)] = 1
    common, size = m @ m.T, np.array([len(s) for s in sets])
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.triu((common > 0) & (common * 100 >= (size[:, None] + size - common) * percent), 1))):
        x, y = find(a), find(b)
        root[max(x, y, key=lambda r: ids[r])] = min(x, y, key=lambda r: ids[r])
    return {d: (int(n), ids[find(i)]) for i, (d, n) in enumerate(zip(ids, size))}


def families(random):
    """Near copies, documents of shared passages, copies, and short, empty and very long texts."""
    word = lambda: "w" + str(int(random.integers(0, 3000)))
    passages = [[word() for _ in range(40)] for _ in range(6)]
    out: list[str | None] = []
    for _ in range(12):
        base = [word() for _ in range(int(random.integers(5, 150)))]
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(word() if random.random() < share else w for w in base))
    for _ in range(60):
        some = [passages[i] for i in random.choice(6, 3, replace=False)]
        out.append(" ".join(sum(some, []) + [word() for _ in range(int(random.integers(0, 20)))]))
    out += [out[0].upper(), out[1], out[1], "one two", "one two", "One  two", "one", None, "", " \n ", None, " ".join(word() for _ in range(20_000))]
    return out


@pytest.mark.parametrize(("needs", "pairs", "cells"), [((1,), 2, 2), ((1, 2, 4, 8, 16), 32, 1 << 20), ((1, 8, 64), 4, 1 << 10), ((16, 32), 1, 64)])
def test_ngram_join_equals_brute_force(spark, needs, pairs, cells):
    random = np.random.default_rng(len(needs) + pairs)
    texts = families(random)
    ids = [int(x) for x in random.permutation(len(texts)) * 3 - 50]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, n long, id long").repartition(4)
    spec = ngram_join.JoinSpec(words=5, percent=80, needs=(1, *needs) if needs[0] > 1 else needs, pairs=pairs, cells=cells)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(df, spec).collect()}
    assert found == brute_components(ids, texts, 5, 80)


def test_ngram_join_of_repeats_and_nothing(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "other words here"), (3, text)], "doc_id long, text string")
    out = ngram_join.similar_documents(df).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3]
    assert {r["component_id"] for r in out if r["doc_id"] < 3} == {1}
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def test_tables_between_steps_are_removed(spark):
    remove_stored(spark)
    df = stored(spark.range(3), "some")
    assert df.count() == 3 and remove_stored(spark) == 1 and remove_stored(spark) == 0


def test_rows_with_keys_are_shuffled_once_and_go(spark):
    rows = spark.createDataFrame([(i % 40, i, 5, 1) for i in range(200)], "key long, id long, n long, need int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = near_dedup.shared_keys(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"- Exchange hashpartitioning\(key", plan)) == 1 and "ReusedExchange" in plan
    assert near_dedup.shared_keys(rows).count() == 200
    remove_stored(spark)
    df = spark.createDataFrame([(i, f"a b c d e f{i // 2} g") for i in range(20)], "doc_id long, text string")
    assert ngram_join.similar_documents(df).count() == 20
    kept = [re.sub("-[0-9a-f]{32}$", "", path).rsplit("tidemark-")[-1] for path in STORED]
    assert "named" in kept and not {"fingerprints", "keyed-classes"} & set(kept)


def test_prefixes_lose_no_partner():
    """Random pairs of sets at the threshold share what the less demanding asks for."""
    random = np.random.default_rng(5)
    spec = ngram_join.JoinSpec(cells=1 << 10)
    counts = random.integers(0, 4000, spec.cells).astype(np.int64)
    seen = set()
    for _ in range(400):
        n = int(random.integers(1, 300))
        whole = np.unique(random.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        common = whole[:n]
        extra = len(common) // 4  # of union 1.25 n, so just 80 %
        cut = int(random.integers(0, extra + 1))
        a, b = np.sort(np.concatenate([common, whole[n : n + cut]])), np.sort(np.concatenate([common, whole[n + cut : n + extra]]))
        (need_a, keys_a), (need_b, keys_b) = (ngram_join.prefix(s, counts, float(random.integers(0, 3000)), spec) for s in (a, b))
        seen |= {need_a, need_b}
        assert len(np.intersect1d(keys_a, keys_b)) >= min(need_a, need_b)
    assert len(seen) > 3


def test_prefixes_tell_shared_shingles_from_chance():
    """Among 3 million documents of 530 shingles each, a shingle that 60 documents share is told from those that one holds."""
    random = np.random.default_rng(9)
    spec = ngram_join.JoinSpec()
    mean = 3e6 * 530 / spec.cells
    counts = random.poisson(mean, spec.cells).astype(np.int64)
    own = np.unique(random.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    shared = random.choice(own, 400, replace=False)
    np.add.at(counts, ngram_join.cells_of(shared, spec.cells), 60)
    counts = ngram_join.Levels((np.searchsorted(ngram_join.LEVELS, counts, "right") - 1).astype(np.uint8))
    need, keys = ngram_join.prefix(own, counts, mean + 4 * mean**0.5, spec)
    assert len(keys) == len(own) - 800 + need and not np.isin(keys, shared).any()


def test_counters_equal_plain_counts(spark):
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in random.integers(0, 4, int(n))) for n in random.integers(0, 90, 300)] + [None, "a b c d e f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c d e f")], "doc_id long, text string").repartition(4)
    spec = ngram_join.JoinSpec(cells=1 << 8)
    want = np.zeros(spec.cells, np.int64)
    for own in near_dedup.Shingler(spec).sets(pa.array([t or "" for t in texts], pa.large_string())):
        np.add.at(want, ngram_join.cells_of(own, spec.cells), 1)
    found = ngram_join.document_counts(df, spec, 1 << 5)
    assert want.max() > 64 and (ngram_join.LEVELS[np.searchsorted(ngram_join.LEVELS, want, "right") - 1] == found[np.arange(spec.cells)]).all()
    assert found[np.arange(spec.cells)].max() > 0 and ngram_join.document_counts(df.limit(0), spec).mean() == 0
    for counts in (want, np.array([0, 0, 1 << 31, 5, 70_000]), np.zeros(3, np.int64)):
        assert (ngram_join.unpacked(*ngram_join.packed(counts), len(counts)) == counts).all()


def test_shuffled_texts_go_before_pairs_are_compared(spark, monkeypatch):
    """Whole texts are shuffled where sets are fetched; the files of that and of each comparison don't stand at once."""
    steps = []
    for module in (near_dedup, ngram_join):
        monkeypatch.setattr(module, "release_shuffles", lambda spark: steps.append("release"))
    keep = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: steps.append(name) or keep(df, name))
    df = spark.createDataFrame([(i, f"a b c d e f{i // 2} g") for i in range(20)], "doc_id long, text string")
    assert ngram_join.similar_documents(df).count() == 20
    for one, other in (("sets", "star-edges"), ("more-sets", "pair-links"), ("pair-links", "missed")):
        assert "release" in steps[steps.index(one) : steps.index(other)]
    assert "release" in steps[: steps.index("fingerprints")]  # the counters' shuffle


def test_a_star_between_unlike_documents_loses_no_link(spark):
    """Thousands of documents from one stock of sentences stand between two near copies."""
    random = np.random.default_rng(17)
    stock = [" ".join("v" + str(int(random.integers(0, 5000))) for _ in range(9)) for _ in range(100)]
    some = lambda n: sorted(random.choice(100, n, replace=False))
    texts = [" . ".join(stock[i] for i in some(68)) for _ in range(3794)]
    whole = some(68)
    swapped = " . ".join(stock[i] for i in whole).split()
    for at in (60, 300, 500, 640):
        swapped[at : at + 8] = [f"new{at}{j}" for j in range(8)]
    texts += [" . ".join(stock[i] for i in whole), " ".join(swapped)]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(8)
    pair = sets_of(texts[-2:], 3)
    assert 0.85 <= len(pair[0] & pair[1]) / len(pair[0] | pair[1]) < 0.9
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert found == brute_components(ids, texts, 3, 85)
    assert found[ids[-1]][1] == ids[-2]
    pair = sets_of(texts[-2:], 5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(df, ngram_join.JoinSpec(percent=75)).collect()}
    assert found == brute_components(ids, texts, 5, 75)


# Hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, spec, every):
    """rows: (vec_id, label, vector), ids distinct."""
    usable = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, q in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other == label) for j, other, v in usable if j != i and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2]][: spec.positives]:
            fits = [(s, j) for s, j, same in scored if not same and spec.low * -p <= 100 * -s <= spec.high * -p][: spec.negatives]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, spec, every):
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), spec)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("clusters", [1, 12])
@pytest.mark.parametrize("tile", [40, 8_192])
def test_hard_negatives_equal_brute_force(spark, clusters, tile):
    random = np.random.default_rng(clusters)
    centres = random.normal(size=(clusters, 8)) * (3 if clusters > 1 else 0)
    rows = [(i, int(random.integers(0, 4)), [float(x) for x in np.float32(centres[i % clusters] + random.normal(size=8))]) for i in range(1, 700)]
    rows += [(1000 + i, [0, 9][i % 2], rows[0][2]) for i in range(90)]  # one vector many times, and a label of few rows
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [1.0] * 7 + [float("nan")]), (2030, 1, [float("inf")] * 8), (2040, 1, [None] * 8), (None, 1, rows[0][2])]
    rows += [(2050 + i, i % 2, [0.5 * i] * 3) for i in range(20)] + [(3000, 5, [0.0] * 8), (3010, 1, [0.0] * 8), (3020, 1, []), (3030, 1, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, score long, band int").repartition(3)
    spec = hard_negatives.MineSpec(anchor_tile=tile, candidate_tile=tile, sample=200, anchor_leaf=4, candidate_leaf=8)
    want = brute_negatives([r for r in rows if r[0] is not None], spec, 10)
    assert len(want) > 1000
    assert mined(df, spec, 10) == want


def test_hard_negatives_of_repeats_large_numbers_and_nothing(spark):
    spec = hard_negatives.MineSpec()
    schema = "vec_id long, label int, embedding array<double>"
    assert mined(spark.createDataFrame([], schema), spec, 1) == []
    assert mined(spark.createDataFrame([(10, 1, [1.0])], schema), spec, 10) == []
    repeated = spark.createDataFrame([(10, 1, [1.0]), (10, 1, [1.0]), (11, 1, [1.0]), (11, 1, [1.0]), (12, 2, [0.5]), (12, 2, [0.5])], schema)
    one, half = 256 * 256, 256 * 128
    assert mined(repeated, spec, 10) == sorted((10, 11, r, 12, one, half) for r in (1, 2) for _ in range(2))
    big = 2.0**20 + 1.0  # products over 2^52
    rows = [(0, 1, [big, 1.0]), (1, 1, [2.0**22, 1.0]), (2, 2, [2.0**21, 3.0]), (3, 2, [-(2.0**21), 0.0])]
    assert brute_negatives(rows, spec, 10)
    assert mined(spark.createDataFrame(rows, schema), spec, 10) == brute_negatives(rows, spec, 10)


def test_trees_prune_whole_groups():
    """On clustered vectors, with leaves of a few rows, not all pairs are scored; the best are found all the same."""
    random = np.random.default_rng(2)
    centres = random.normal(size=(40, 32)) * 4
    x = np.floor(64 * (centres[np.arange(4000) % 40] + random.normal(size=(4000, 32))))
    labels = random.integers(0, 3, 4000)
    anchors, candidates = hard_negatives.Local(x[:400], labels[:400], 4), hard_negatives.Local(x, labels, 16)
    shape = (400, 1)
    wanted = hard_negatives.Wanted(np.full(shape, hard_negatives.NONE), np.full(shape, 2**62), np.full(shape, hard_negatives.NONE), 5)
    scored = hard_negatives.search(anchors, np.arange(400)[anchors.order], candidates, np.arange(4000)[candidates.order], wanted, True)
    assert scored < 0.9 * 400 * 4000 / 3
    a, _, ids, score = wanted.result()
    own = anchors.order[a]
    exact = (x[:400] @ x.T) - np.where((labels[:400, None] == labels) & (np.arange(400)[:, None] != np.arange(4000)), 0, 1e15)
    assert (np.sort(exact, axis=1)[own, -1] == np.maximum.reduceat(score, np.flatnonzero(np.diff(a, prepend=-1)))[np.unique(a, return_inverse=True)[1]]).all()

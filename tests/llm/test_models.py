import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality, toxicity
from tidemark.llm.common import fold_expr
from tidemark.llm.subwords import bucket_of, mix, read_words, spelling_hashes


def words(texts):
    return read_words(pa.array(texts, pa.large_string()))


def corpus(n, seed):
    """Sentences of syllables; every fifth document holds an insult in one sentence."""
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(["ba", "do", "ki", "lu", "me", "so"], random.integers(1, 4)))
    texts, labels = [], []
    for i in range(n):
        sentences = [[word() for _ in range(random.integers(4, 12))] for _ in range(random.integers(1, 9))]
        if i % 5 == 0:
            sentences[random.integers(len(sentences))].insert(2, random.choice(["zounder", "zounding", "vlix"]))
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append(int(i % 5 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(*corpus(1500, 1))


def test_toxicity_on_held_out(toxic_model):
    texts, labels = corpus(500, 2)
    p = toxicity.Scorer(toxic_model).scores(words(texts))
    assert ((p >= 0.5) == np.array(labels, bool)).mean() > 0.98
    assert ((p >= 0) & (p <= 1)).all()


def test_toxicity_locates(toxic_model):
    text = "ba do ki. lu me zounder so ba\nki ki lu. do do."
    _, found = toxicity.Scorer(toxic_model).located(words(["éé ü. " * 40, text]), 0.5)
    assert found[0] == [] and [text[s["start"] : s["end"]] for s in found[1]] == ["lu me zounder so ba"]


def test_noisy_or_of_sentences(toxic_model):
    scorer = toxicity.Scorer(toxic_model)
    one = lambda t: scorer.documents(words([t]))[0]
    a, b = "ba do vlix ki.", "lu me so."
    assert one(f"{a} {b}") == pytest.approx(1 - (1 - one(a)) * (1 - one(b)))
    many = scorer.documents(words(["", a, " \n ", b, ""]))
    assert many[1] == pytest.approx(one(a)) and many[3] == pytest.approx(one(b)) and many[0] == many[4] == pytest.approx(one(""))


def plain_words(text):
    """Words by their definition, and whether a line ends after each."""
    found = [(m[0], m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [(w, i + 1 == len(found) or "\n" in text[end : end + re.search(r"^[\x20\x09-\x0D]*", text[end:]).end()]) for i, (w, end) in enumerate(found)]


ODD = ["", " ", "\n\n", "a", "Äb,c  Ⅷ\t(d)!\n\n\x0b e. \x1cf\u3000g", "x" * 9000 + "y " + "x" * 9000 + "z", "-- . --", "İ Σ 𝔸𝔸𝔸𝔸 𝔸", "one two\nthree", "so so so. SO so!"]


def test_words_by_their_definition():
    found = words(ODD)
    for d, text in enumerate(ODD):
        own = slice(found.ends[d], found.ends[d + 1])
        spelt = ["".join(map(chr, found.codes[a:b])) for a, b in zip(found.start[own], found.end[own])]
        assert list(zip(spelt, found.closes[own].tolist())) == plain_words(text)
        assert [text[a - found.text_at[d] : b - found.text_at[d]] for a, b in zip(found.start[own], found.end[own])] == spelt
    every = [w for t in ODD for w, _ in plain_words(t)]
    assert len(found.first) == len(set(every)) and [every[i] for i in found.first[found.number]] == every


def whole_hash(spelling):
    codes = np.array([ord(c) for c in spelling], np.uint32)
    return spelling_hashes(codes, np.array([0]), np.array([len(codes)]))


def plain_grams(word, low, high, buckets):
    """Buckets of the n-grams of <word>, one at a time; a word's hash marks the rest."""
    marked, out = f"<{word}>", []
    for n in range(low, high + 1):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
            out.append(int(bucket_of(np.array([h + n - 1], np.uint64), buckets)[0]))
    return out if word else []


def test_toxicity_equals_a_plain_scoring(toxic_model):
    spec, found = toxic_model.spec, toxicity.Scorer(toxic_model).documents(words(ODD))
    for text, score in zip(ODD, found):
        sentences, now = [], set()
        for w, closes in plain_words(text):
            now.add(w)
            if closes or w[-1] in toxicity.STOPS:
                sentences.append(now)
                now = set()
        clean = 1.0
        for sentence in sentences or [set()]:
            odds = toxic_model.bias
            for w in sentence:
                low = "".join(x.lower() if len(x.lower()) == 1 else x for x in w.strip(toxicity.EDGES))
                own = plain_grams(low, spec.low, spec.high, spec.buckets)
                if low:
                    odds += toxic_model.weights[bucket_of(whole_hash(f"<{low}>"), spec.buckets)][0]
                    odds += sum(toxic_model.weights[b] for b in own) / max(1, len(own)) ** 0.5
            clean *= 1 - 1 / (1 + np.exp(-odds))
        assert score == pytest.approx(1 - clean, rel=1e-4, abs=1e-9)


def test_quality_equals_a_plain_scoring():
    texts, labels = corpus(400, 3)
    spec = quality.EmbeddingSpec(buckets=1 << 12, pair_buckets=1 << 12)
    model = quality.fit(texts, labels, spec)
    found = quality.Scorer(model).documents(words(ODD + texts[:20]))
    assert (np.abs(model.vectors[spec.buckets : -1]).max(axis=1) > 1 / spec.width).any()  # pairs are learned
    for text, score in zip(ODD + texts[:20], found):
        every, rows = [w for w, _ in plain_words(text)], []
        for i, w in enumerate(every):
            rows += plain_grams(w, spec.low, spec.high, spec.buckets) + [int(bucket_of(whole_hash(w), spec.buckets)[0])]
            if i:
                pair = mix(whole_hash(every[i - 1]) * np.uint64(3) + whole_hash(w))
                rows += [spec.buckets + int(bucket_of(pair, spec.pair_buckets)[0])] + [spec.rows - 1] * (w == every[i - 1])
        mean = model.vectors[rows].astype(float).mean(axis=0) if rows else np.zeros(spec.width)
        logits = mean @ model.out + model.bias
        assert score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), rel=1e-3, abs=1e-6)


def test_training_documents_hold_what_scoring_counts():
    spec = quality.EmbeddingSpec(buckets=1 << 10, pair_buckets=1 << 10)
    rows, share, begins = quality._documents(words(ODD), spec)
    for d, text in enumerate(ODD):
        every, own = [w for w, _ in plain_words(text)], Counter()
        for i, w in enumerate(every):
            own.update(plain_grams(w, spec.low, spec.high, spec.buckets) + [int(bucket_of(whole_hash(w), spec.buckets)[0])])
            if i:
                own.update([spec.buckets + int(bucket_of(mix(whole_hash(every[i - 1]) * np.uint64(3) + whole_hash(w)), spec.pair_buckets)[0])] + [spec.rows - 1] * (w == every[i - 1]))
        found = dict(zip(rows[begins[d] : begins[d + 1]].tolist(), share[begins[d] : begins[d + 1]].tolist()))
        assert found == pytest.approx({k: v / sum(own.values()) for k, v in own.items()}, rel=1e-5)


def test_the_margin_follows_the_rows_held_back():
    y = np.repeat([True, False], 200)
    random = np.random.default_rng(1)
    odds = random.logistic(0, 1, 400) + np.where(y, 2.0, -2.0)
    plain = lambda c: (((odds >= c) != y).mean())
    assert abs(toxicity.best_margin(odds, y)) < 0.5
    moved = toxicity.best_margin(odds + 3, y)
    assert 2.4 < moved < 3.2 and plain(moved - 3) < plain(0) + 0.02
    assert 0 < toxicity.best_margin(np.array([3.0]), np.array([False])) < 3


def odd_documents(spark):
    rows = [(1, "ba do vlix ki."), (2, None), (3, ""), (4, "lu me " * 50_000), (1, "ba do vlix ki."), (None, "so so")]
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, score string")


def test_models_over_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (3, 1, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    always = F.lit(True)
    for module in (toxicity, quality):
        model = module.train(docs, labels, always)
        out = module.score(docs, model).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
        assert module.score(docs.limit(0), model).count() == 0
        none = module.train(docs, labels.limit(0), always)
        assert len({round(r["score"], 9) for r in module.score(docs, none).where("doc_id is null or doc_id > 3").collect()}) >= 1


def test_folds_match_crc32(spark):
    rows = spark.range(200).select("id", fold_expr("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


@pytest.mark.parametrize("module,label,k,out", [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, module, label, k, out):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = fold_expr("doc_id", k)
    model = module.train(docs, labels, fold != out)
    held = module.score(docs, model).join(labels, "doc_id").where(fold == out)
    right = held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right > 0.9


def test_projected_gradient_meets_targets(spark):
    random = np.random.default_rng(5)
    p = random.dirichlet([0.3, 0.3, 0.3], 400)
    n = random.integers(1, 900, 400)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    have = n @ p
    moves, totals = mixing.solve(rows, have * [0.2, 1.0, 0.7])
    rate = mixing.replay(p, moves)[:, 1]
    assert (rate >= 0).all() and np.allclose((n * rate) @ p, have * [0.2, 1.0, 0.7], rtol=0.01, atol=have.sum() * 1e-3)
    moves, totals = mixing.solve(rows, np.array([np.nan, have[1] * 0.5, have[2]]))
    assert np.allclose(totals[1:], have[1:] * [0.5, 1.0], atol=have.sum() * 1e-3)


def test_mix_reaches_its_targets(spark):
    texts, labels = corpus(600, 4)
    texts = [t if i % 3 else t.replace(". ", ". Qux qux qux ") + " Qux qux." for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), int(x)) for i, x in enumerate(labels)], "doc_id long, quality int, toxic int")
    for weights in ({"good": 0.6, "poor": 0.4}, {"good": 0.7, "poor": 0.3, "toxic": 0.0}):
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            out = mixing.mix(docs, marks, weights).collect()
        p, n = np.array([r["p"] for r in out]), np.array([r["n_tokens"] for r in out])
        assert n.tolist() == [len(texts[r["doc_id"]].split()) for r in out]
        rate, copies = (np.array([r[c] for r in out], float) for c in ("rate", "copies"))
        totals = dict(zip(mixing.DOMAINS, (rate * n) @ p))
        share = {k: v / sum(totals[d] for d in weights) for k, v in totals.items()}
        assert all(abs(share[k] - v) < 0.02 for k, v in weights.items())
        assert (np.abs(copies - rate) < 1).all() and abs((copies * n).sum() / (rate * n).sum() - 1) < 0.1


def test_cells_hold_all_tokens(spark):
    random = np.random.default_rng(8)
    p, n = random.dirichlet([0.5, 0.5, 0.5], 3000), random.integers(0, 50, 3000)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    found = mixing.cells(rows, mixing.MixSpec(grid=16)).collect()
    assert len(found) <= 17 * 17
    assert np.allclose(np.sum([np.array(r["p"]) * r["n_tokens"] for r in found], axis=0), n @ p)


def test_kept_columns_may_not_clash(spark):
    docs = odd_documents(spark)
    with pytest.raises(ValueError):
        quality.score(docs, quality.fit([], []), keep=["doc_id", "score"])


def test_mixing_over_odd_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("score", "rate")
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, {"good": 0.9, "poor": 0.1}).collect()
    assert len(out) == 6 and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-6 for r in out)
    assert mixing.mix(docs.limit(0), labels, {"good": 1.0}).count() == 0


def test_the_mix_holds_no_toxic_share(spark, sf_dir):
    from tidemark.llm.queries import op7_mixing

    out = op7_mixing(spark, sf_dir)
    tokens = {d: F.sum(F.col("copies") * F.col("n_tokens") * F.col(f"p_{d}")) for d in mixing.DOMAINS}
    kept = out.agg(*(c.alias(d) for d, c in tokens.items())).first()
    assert kept["toxic"] < 0.03 * sum(kept) and kept["good"] > 0.8 * sum(kept)

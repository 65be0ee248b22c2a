import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import audio, vector_search


def test_media_round_trip(spark, tmp_path):
    texts = ["", None, "x" * 192, "y" * 193, "é" * 5000, "same", "same", "z" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("payload"), F.lit(1).alias("media"))
    stored = audio.store_features(audio.features(audio.store_media(df, path=str(tmp_path / "m"))), path=str(tmp_path / "f"))
    rows = {r["doc_id"]: r for r in audio.tensor_means(stored).withColumn("digest", audio.feature_digest()).collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        padded = body.ljust(max(1, -(-len(body) // 192)) * 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        stored = audio.wav(padded, 16_000)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert audio.wav_samples(stored) == padded
        patches = audio.read_patches(bytes(r["patches"]))
        assert patches.num_rows == -(-r["n_frames"] // 16)
        assert patches.schema.field("log_mel").type.shape == [16, 40]
        assert hashlib.sha256(bytes(r["patches"])).hexdigest() in r["digest"]
        x = (np.frombuffer(padded, np.uint8).astype(np.float32) - 128) / 128
        mels = audio.log_mel(audio.resample(x, audio.AudioSpec()), audio.AudioSpec())[0]
        tensors = patches.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, 40)
        assert np.allclose(tensors[: len(mels)], mels, rtol=1e-3, atol=1e-3) and np.allclose(tensors[len(mels) :], np.log(1e-6), atol=1e-2)
        assert np.allclose(r["mel_mean"], mels.mean(axis=0), rtol=1e-3, atol=2e-3)
    assert rows[5]["digest"] == rows[6]["digest"] != rows[2]["digest"]
    assert audio.store_media(df.limit(0), path=str(tmp_path / "n")).count() == 0


def test_wav_is_wav():
    import io
    import wave

    with wave.open(io.BytesIO(audio.wav(bytes(range(192)), 16_000))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(999)) == (1, 1, 16_000, bytes(range(192)))


def test_resampling_keeps_a_tone():
    spec = audio.AudioSpec()
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32), spec)
    assert len(y) == 12_000
    spectrum = np.abs(np.fft.rfft(y[1000:11_000]))
    assert abs(spectrum.argmax() * 12_000 / 10_000 - 500) < 3
    assert 0.9 < y[2000:10_000].max() < 1.1
    high = audio.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32), spec)  # over the new half rate
    assert np.abs(high[2000:10_000]).max() < 0.2


def test_resampling_by_definition():
    spec = audio.AudioSpec(block=1)
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    up = np.zeros(len(x) * spec.up)
    up[:: spec.up] = x
    taps = np.empty(spec.taps_per_phase * spec.up)
    for p in range(spec.up):
        taps[p :: spec.up] = spec.phases[p][::-1]
    whole = np.convolve(np.concatenate([up, np.zeros(100)]), taps)
    lead = (spec.taps_per_phase - 1 - spec.taps_per_phase // 2) * spec.up
    want = whole[lead:][:: spec.down][: len(x) * spec.up // spec.down]
    assert np.allclose(audio.resample(x, spec), want, atol=1e-4)


def test_log_mel_by_definition():
    spec = audio.AudioSpec()
    y = np.random.default_rng(2).normal(size=2000).astype(np.float32)
    mels, energy = audio.log_mel(y, spec)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + 6000 / 700), 42)]
    for i in (0, 3, len(mels) - 1):
        frame = np.zeros(384)
        own = y[i * 144 : i * 144 + 384]
        frame[: len(own)] = own
        assert np.isclose(energy[i], 10 * np.log10((frame**2).mean() + 1e-10), atol=1e-3)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(384) / 383)
        power = [abs(sum(frame * window * np.exp(-2j * np.pi * k * np.arange(384) / 384))) ** 2 for k in range(193)]
        for m in (0, 7, 39):
            low, mid, high = edges[m : m + 3]
            weight = [max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in np.arange(193) * 12_000 / 384]
            assert np.isclose(mels[i, m], np.log(np.dot(weight, power) + 1e-6), rtol=1e-3, atol=1e-3)


def test_spans_have_hysteresis():
    spec = audio.AudioSpec(on_db=3.0, off_db=0.0, least_frames=2)
    e = np.array([-5, 1, 5, 1, 1, -5, 1, 1, -5, 5, -5], float)
    e -= e.mean()
    assert audio.active_spans(e + 0.0, spec) == [(2, 5)]
    assert audio.active_spans(np.empty(0), spec) == []


def brute(rows, k=5):
    clean = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % 50 == 0:
            found = sorted((-int(v @ w), i) for i, w in clean if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=21).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [None] * 21), (402, [float("nan")] * 21), (450, [float("inf")] * 21), (None, [0.0] * 21), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (550, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for tiles in ((4, 50), (2048, 8192)):
        out = vector_search.top_k(df, F.col("vec_id") % 50 == 0, query_tile=tiles[0], candidate_tile=tiles[1])
        assert sorted(map(tuple, out.collect())) == brute(single)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows with the query's id are the query and no candidates; other repeated rows are candidates each."""
    rows = [(50, [1.0, 0.0]), (50, [0.9, 0.0]), (7, [0.5, 0.0]), (7, [0.5, 0.0]), (7, [0.25, 0.0]), (8, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = vector_search.top_k(df.where("vec_id <> 50 or embedding[0] = 1"), F.col("vec_id") == 50, k=3).collect()
    assert sorted(map(tuple, out)) == [(50, 1, 7, 256 * 128), (50, 2, 7, 256 * 128), (50, 3, 7, 256 * 64)]
    assert {r["vec_id"] for r in vector_search.top_k(df, F.col("vec_id") == 50, k=9).collect()} == {7, 8}


def test_bounds_never_exceed_distances():
    random = np.random.default_rng(4)
    for dim in (1, 2, 3, 7, 33, 64):
        x, q = random.normal(size=(60, dim)) * 100, random.normal(size=(9, dim)) * 100
        true = ((q[:, None] - x) ** 2).sum(axis=2)
        axes = vector_search.principal_axes(x)
        assert np.allclose(axes.T @ axes, np.eye(dim))
        last = None
        for level in vector_search.LEVELS:
            bound = vector_search.lower_bounds(vector_search.segment_statistics(q @ axes, level), vector_search.segment_statistics(x @ axes, level))
            assert (bound <= true + 1e-6).all()
            assert last is None or bound.mean() >= last.mean() - 1e-9
            last = bound


def test_segment_statistics_by_definition():
    x = np.random.default_rng(5).normal(size=(4, 20))
    found = vector_search.segment_statistics(x, (0.25, 8))
    edges = vector_search.segment_edges(20, (0.25, 8)).tolist()
    assert edges == [0, 1, 2, 3, 4, 5, 10, 18, 20]
    means = [x[:, a:b].mean(axis=1) * (b - a) ** 0.5 for a, b in zip(edges, edges[1:])]
    deviations = [x[:, a:b].std(axis=1) * (b - a) ** 0.5 for a, b in zip(edges, edges[1:]) if b - a > 1]
    assert np.allclose(found, np.stack(means + deviations, axis=1))


def test_most_pairs_need_no_exact_score():
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 64))
    near = centres[random.integers(0, 40, 4000)] + 0.35 * random.normal(size=(4000, 64))
    for x, most in ((near, 0.02), (random.normal(size=(4000, 64)), 0.1)):
        x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
        ids = np.arange(len(x))
        tile = vector_search.Tile(x[::50], ids[::50], x, ids, 5, vector_search.principal_axes(x[:2048]))
        q, c, score = tile.top()
        assert tile.compared == 80 * 3999 and tile.survived < most * tile.compared
        full = x[::50] @ x.T
        for i, own in enumerate(ids[::50]):
            order = [j for j in np.lexsort((ids, -full[i])) if j != own][:5]
            assert c[q == own].tolist() == order and score[q == own].tolist() == full[i, order].tolist()


def test_large_integers_stay_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**62, 1.0]])
    found = vector_search.Tile(q, np.array([0]), x, np.array([1, 2]), 2).top()
    assert [f.tolist() for f in found] == [[0, 0], [2, 1], [2**63 - 1, 2**60 + 3]]


def test_frames_cover_the_end_of_a_medium():
    spec = audio.AudioSpec()
    for n in (1, 144, 384, 385, 432, 528, 14_400):
        mels, energy = audio.log_mel(np.ones(n, np.float32), spec)
        assert (len(mels) - 1) * spec.hop + spec.frame >= n > (len(mels) - 2) * spec.hop + spec.frame or len(mels) == 1
    text = bytes(range(40, 104)) * 15
    ends = [audio.describe(text[:-50] + tail + text[-8:], spec) for tail in (b"a" * 42, b"z" * 42)]
    assert len(text) % 192 == 0 and ends[0]["patches"] != ends[1]["patches"]

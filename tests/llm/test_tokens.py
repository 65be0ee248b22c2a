import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, token_files
from tidemark.llm.queries import RANKS, WORD_TOKENIZER, bpe_digest

ODD = ["", " ", "\n\n", "a\x1cb c\x85d", "Ça ÉTÉ İstanbul ΣΑΣ", "a,b ,, x., don't I'm. 12.5, é́ é", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "　x y\tz\r\nq", "x" * 50_000, "ab.,cd. ,.", "ﬁ ǅ. 日本語", "the the. THE, The"]


def frame(spark, texts=ODD):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, None), (3, "again", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def want_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        _tokenizer
    except NameError:
        _tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    return _tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files(spark, tmp_path):
    df = frame(spark)
    path = token_files.write_tokens(df, WORD_TOKENIZER, path=str(tmp_path / "t"), row_group_rows=4)
    store = token_files.read_tokens(spark, path)
    rows = token_files.with_starts(token_files.id_checksums(store), store).collect()
    rows = sorted(rows, key=lambda r: r["start"])
    source = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text) in zip(rows, source, strict=True):
        ids = want_ids(text)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    texts = [f"{chr(i)}. b{chr(i)}, .{chr(i)}" for i in range(0x30000) if not 0xD800 <= i < 0xE000] + ["KAD\u0130. ok", "\u0130, \u0130.", "[\u0130\u03a3]. \u03a3,", "H\u0331. h\u0331, H\u0331a E\u0301. K\u0307,"]
    texts += [f"x{chr(a)}{chr(b)} {chr(a)}{chr(b)}." for a in range(128) for b in range(128)] + ["<|STARTOFTEXT|>. <|startoftext|>, A<|endoftext|>."]
    encoder, library = token_files.WordEncoder(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER)
    ids, ends = encoder.encode(pa.array(texts, pa.large_string()))
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.chunked and not [t for t, e, a, b in zip(texts, want, ends[:-1], ends[1:]) if e.ids != ids[a:b].tolist()]


def test_a_file_whose_tokens_hold_blanks():
    """Its texts go through the library whole."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    ids, ends = encoder.encode(pa.array(ODD, pa.large_string()))
    assert not encoder.chunked
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


def test_token_file_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    path = token_files.write_tokens(docs, WORD_TOKENIZER, path=str(tmp_path / "t"), row_group_rows=500, page_rows=100)
    for f in glob.glob(f"{path}/*.parquet"):
        m = pq.ParquetFile(f).metadata
        assert all(m.row_group(i).num_rows <= 500 for i in range(m.num_row_groups))
        column = m.row_group(0).column(m.num_columns - 1)
        assert column.has_dictionary_page and column.has_offset_index
    plan = token_files.token_starts(token_files.read_tokens(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<shard:int,n_tokens:bigint>" in plan


def test_token_files_of_nothing(spark, tmp_path):
    store = token_files.read_tokens(spark, token_files.write_tokens(frame(spark).limit(0), WORD_TOKENIZER, path=str(tmp_path / "t")))
    assert token_files.with_starts(token_files.id_checksums(store), store).count() == 0


def test_word_encoder_equals_library_on_corpus(spark, sf_dir):
    import pyarrow as pa

    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids, ends = token_files.WordEncoder(WORD_TOKENIZER).encode(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == want_ids(t)[:-1]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_library(spark, sf_dir, reference):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in texts + ODD + ["aaaa" * 999, " \u0000", "▁⁇ <unk>"]:
        ids = np.frombuffer(bpe.encode(t), "<i4")
        assert ids.tolist() == reference.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_byte_bpe_frames(spark, reference):
    import hashlib

    df = frame(spark)
    out = bpe_digest(byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)).collect()
    want = []
    for r in df.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(nulls, RANKS, public_tokenizers.PATTERN).first()["decoded"]) == b""

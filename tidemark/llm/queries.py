"""The corpus operators' queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, byte_bpe, hard_negatives, html_text, line_dedup, mixing, near_dedup, ngram_join, phrases, quality, token_files, toxicity, vector_search
from .common import fold_expr, table

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1)
    store = token_files.read_tokens(spark, path)
    placed = token_files.with_starts(token_files.id_checksums(store), store)
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return bpe_digest(byte_bpe.decode(ids, RANKS, PATTERN))


def bpe_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    found = audio.tensor_means(audio.store_features(audio.features(audio.store_media(docs))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", audio.feature_digest().alias("feature"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_expr("doc_id", 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_expr("doc_id", 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold != 1)
    return quality.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


#: Shares of tokens by domain that op7 aims at.
TARGET_WEIGHTS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGET_WEIGHTS)
    shares = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.learn(pages))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearSpec(words=3, percent=85))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), phrases.PhraseSpec(longest=5, least=100, best=2_000))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), ngram_join.JoinSpec(words=5, percent=80))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, hard_negatives.MineSpec(positives=5, negatives=10, low=30, high=90))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_audio": op3_audio,
        "op4_vector_search": op4_vector_search,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_html_text": op8_html_text,
        "op9_line_dedup": op9_line_dedup,
        "op10_near_dedup": op10_near_dedup,
        "op11_phrases": op11_phrases,
        "op12_ngram_join": op12_ngram_join,
        "op13_hard_negatives": op13_hard_negatives,
    }


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.first_doc IS NOT NULL AND f.first_doc < k.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f ON f.key = k.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _similar_sql(k: int, percent: int, more: str = "") -> str:
    """Documents by components of links of ``percent`` on sets of ``k``-word shingles."""
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {k}
    THEN list_transform(range(1, len(w) - {k} + 2), lambda i: {gram})
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
), sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)
), reach AS (
  SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, w.doc_id) AS component_id{more}
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.doc_id = w.doc_id
"""


OP10_SQL = _similar_sql(3, 85, ", coalesce(l.component_id, w.doc_id) = w.doc_id AS kept")
OP12_SQL = _similar_sql(5, 80)

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), counted AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), total AS (SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE k = 1 GROUP BY 1),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 100),
inner_parts AS (
  SELECT lang, unnest([array_to_string(w[:k - i], ' ') || '' FOR i IN [1, 2, 3] IF k - i > 1]
         || [array_to_string(w[2:k - i + 1], ' ') FOR i IN [1, 2, 3] IF k - i > 1]
         || [array_to_string(w[3:k - i + 2], ' ') FOR i IN [2, 3] IF k - i > 1]
         || [array_to_string(w[4:5], ' ') FOR i IN [3] IF k = 5]) AS phrase, f FROM found
), longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
alone AS (
  SELECT c.* FROM found c LEFT JOIN longer l ON l.lang = c.lang AND l.phrase = c.phrase WHERE l.f IS NULL OR 100 * l.f < 100 * c.f
), cuts AS (
  SELECT lang, phrase, f AS a, i, array_to_string(w[:i], ' ') AS first, array_to_string(w[i + 1:], ' ') AS rest
  FROM alone, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i < k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.i, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN total t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_search": OP4_SQL, "op9_line_dedup": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_phrases": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_hard_negatives": OP13_SQL}

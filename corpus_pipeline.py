"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage's result as Parquet in the shared
folder and rereads it as the next one's input.

Toxic documents go; repeated lines go but for their first document, and with them
documents that had nothing else; of near duplicates one stays; documents of domains that
the target weights hold below their share are thinned; the rest become token ids.
n_chars follows the text.

Defined cases of every stage: columns of the input beside those of documents are left
out, whatever their names; texts are taken whole, however long; an empty table gives an
empty one with the same columns. What a stage makes of nulls, ties and repeated rows
stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, line_dedup, mixing, near_dedup, toxicity
from tidemark.llm.common import stored, table
from tidemark.llm.queries import PATTERN, RANKS, bpe_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shares of tokens by domain that the mix aims at.
TARGET_WEIGHTS = {"good": 0.97, "poor": 0.03}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model learns from all labelled rows of the input.

    A null or empty text is one empty sentence, and stays; a null doc_id has no label and is
    judged like any; rows that repeat have one fate; a score of just 0.5 goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines an earlier document holds; documents that lose all they had go.

    A null or empty text stays as it is; rows with a null doc_id keep all lines; rows that
    repeat a doc_id are one document, which never takes a line from itself. Of documents
    with the same line the smallest doc_id keeps it.
    """
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    blank = F.length(F.btrim("text", F.lit(line_dedup.BLANKS.decode()))) == 0
    left = kept.where((F.col("n_dropped") == 0) | ~blank)
    changed = F.col("n_dropped") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked at 0.8 or more on five-word shingles.

    Null, empty and wordless texts are like no other and stay, as do rows with a null
    doc_id; fewer than five words are one shingle; rows that repeat a doc_id share its fate.
    """
    found = near_dedup.near_duplicates(docs, near_dedup.NearSpec(words=5, percent=80, rows=6))
    gone = found.where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept by their rates towards TARGET_WEIGHTS, none more than once.

    The targets ask for every good token once (with a little headroom, so that a good
    document's rate isn't below one by a trifle), whatever the other domains hold; those
    are thinned to their share, and kept where they have less. Null and empty texts have
    no tokens and stay, as do rows with a null doc_id; rows that repeat a doc_id go together.
    Of documents with equal rates a hash of the doc_id chooses.
    """
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGET_WEIGHTS, headroom=1.05, whole="good")
    gone = mixed.where("copies = 0 and n_tokens > 0").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to.

    A null or empty text has no ids; rows that repeat and rows with a null doc_id stay.
    """
    return bpe_digest(byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_domains),
    ("byte_bpe", encode_tokens),
]

#: Learned models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")

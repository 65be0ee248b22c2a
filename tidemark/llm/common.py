"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker keeps in a memo of words before it starts a fresh one.
MEMO_ENTRIES = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session uses a folder of the warehouse, and
    checkpoints go there too; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(f"{warehouse}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


#: Folders written by ``stored`` and not removed yet.
STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The files stay,
    as results read them, until ``remove_stored``.
    """
    path = new_path(df.sparkSession, name)
    STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> bool:
    """Remove a stored table that nothing reads any more: all that was made from it has been written."""
    if path in STORED:
        STORED.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def remove_stored(spark: SparkSession) -> int:
    """Remove the tables that this driver's operators have written between their steps; for when their results have been written. How many went."""
    removed = 0
    while STORED:
        removed += discard(spark, STORED[-1])
    return removed


def release_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage, by which Spark's cleaner learns what shuffles and broadcasts of written steps can go; it does so by itself every half hour (``spark.cleaner.periodicGC.interval``)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose Arrow buffers stay near ``most`` bytes; one huge row is its own batch."""
    for b in batches:
        n, size = b.num_rows, max(1, b.nbytes)
        step = max(1, n * most // size)
        for at in range(0, n, step):
            yield b.slice(at, step)


def release_memory() -> None:
    """Gives freed memory back, so that a worker that Spark keeps holds no more than its memos."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``make()``'s function over bounded Arrow batches of ``columns``, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in text_batches(batches):
            if b.num_rows:
                yield one(b)
        release_memory()

    return df.select(*columns).mapInArrow(run, schema)


def checked_keep(keep: list[str], *made: str) -> None:
    """Kept columns may not have the name of one that the operator makes."""
    clash = {k.lower() for k in keep} & set(made)
    if clash:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")


def string_list(column: pa.Array) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


class Memo(dict):
    """A mapping filled on demand; starts afresh before it outgrows half of ``MEMO_ENTRIES``."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES // 2:
            self.clear()
        value = self[key] = self.make(key)
        return value


def fold_expr(column: str, k: int):
    """crc32 of an id as text, modulo ``k``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(k))


def label_sample(labels: DataFrame, name: str, where, bounds: dict[int, int]) -> DataFrame:
    """At most ``bounds[v]`` labelled ids for each value v of ``name``, by a hash of the id.

    Ids or labels that are null are skipped; an id labelled twice counts with its
    highest label. The result has at most ``sum(bounds.values())`` rows.
    """
    seen = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & where)
    seen = seen.groupBy("doc_id").agg(F.max(F.col(name).cast("int")).alias("label"))
    out = None
    for value, most in bounds.items():
        part = seen.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        out = part if out is None else out.unionByName(part)
    return out


#: Code points of the longest text that a classifier learns from.
LONGEST = 16_384


def fit_on_sample(docs: DataFrame, chosen: DataFrame, bound: int, fit: Callable[[list[str], list[int]], object]) -> object:
    """``fit(texts, labels)`` over the chosen ids in a fixed order, at most one text an id.

    ``chosen`` has at most ``bound`` rows by construction and texts longer than ``LONGEST``
    teach nothing, so rows and bytes are bounded: the ids may be broadcast and one task may
    hold the sample. The fit runs in that task; the driver gets the model alone.
    """
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.length("text") <= LONGEST)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .limit(bound)
        .coalesce(1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")))]
        held.sort(key=lambda r: r[0])
        model = fit([r[1] for r in held], [r[2] for r in held])
        del held
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        release_memory()

    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def split_words(texts: pa.Array, separator: str | None = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a batch of texts, each word's number, and each text's end.

    ``separator`` None cuts at runs of ASCII white space and makes no empty words.
    """
    if separator is None:
        texts = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    coded = lists.flatten().dictionary_encode()
    words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if separator is None and "" in words:  # blank texts
        empty = numbers == words.index("")
        ends = ends - np.concatenate([[0], np.cumsum(empty)])[ends]
        numbers = numbers[~empty]
    return words, numbers, ends


def whole_texts(column: pa.Array) -> pa.Array:
    """A text column as large strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[s : s + n]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return values[at]

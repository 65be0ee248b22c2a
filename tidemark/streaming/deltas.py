"""Bins kept up to date by differences: a batch adds the state of its readings and takes off that of the readings they replace.

Counts, sums and sums of squares form a group, so a replaced or deleted reading's part can
be subtracted, and no bin's readings are summed again. What a batch's readings do is a row for
each reading that comes (sign 1) or goes (sign -1), kept by day and batch; the last row of a key
tells what is held. A batch joins its keys with the rows of the days it touches, writes rows for
what changes alone, and commits their sums by bin as its differences; a bin's state is the sum
over the batches. Sums are exact where the metric has a scale.

A batch's commits name the batch, so a retried one sees what earlier batches left and replaces
its own rows and differences; ``fold`` sums committed batches into one row a bin and keeps one
row a reading that is held.
"""

from __future__ import annotations

import time as clock
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.durations import UNIT_MS
from ..functions.monoid import Metric, coerce
from ..functions.timeaxis import epoch_ms, floor_bin
from ..sources.commits import Versioned
from ..sources.files import bucket_of

DAY = UNIT_MS["d"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READING = ["ts", "key"]


def _names(metrics: list[Metric]) -> list[str]:
    return [f"v{i}" for i in range(len(metrics))]


def _day() -> Column:
    return F.floor(F.col("ts") / DAY)


def arrived(batch: DataFrame, bin_: str, metrics: list[Metric], key: list[str], time: str, order: str, deleted: str | None = None, replace: bool = True) -> DataFrame:
    """A row a reading that the batch names: whether it takes away what was held (``cleared``), whether a reading of its own is left at its end (``comes``), and that one's values.

    Rows of one key go in the order of ``order``, nulls last; of those that tie deletions are last.
    """
    names = _names(metrics)
    own = F.col("device_id").cast("long")
    gone = F.coalesce(F.expr(deleted), F.lit(False)) if deleted else F.lit(False)
    rows = batch.select(
        own.alias("device_id"), floor_bin(epoch_ms(time), bin_).alias("ts"), F.to_json(F.struct(own.alias("_device"), *key)).alias("key"), F.col(order).alias("seq"), gone.alias("gone"), *(coerce(F.expr(m.value)).alias(n) for n, m in zip(names, metrics))
    )
    at = F.struct(F.col("seq").isNull().alias("unplaced"), "seq", "gone", *names)
    if replace:
        found = rows.groupBy(*READING).agg(F.max("device_id").alias("device_id"), F.max(at).alias("own")).withColumn("cleared", F.col("own.gone")).withColumn("comes", ~F.col("own.gone"))
    else:
        if deleted:
            rows = rows.withColumn("away", F.max(F.when(F.col("gone"), at)).over(Window.partitionBy(*READING)))
            first = F.min(F.when(~F.col("gone") & (F.col("away").isNull() | (at > F.col("away"))), at))
        else:
            first = F.min(at)
        found = rows.groupBy(*READING).agg(F.max("device_id").alias("device_id"), first.alias("own"), F.bool_or("gone").alias("cleared")).withColumn("comes", F.col("own").isNotNull())
    return found.select("device_id", *READING, "cleared", "comes", *(F.col(f"own.{n}").alias(n) for n in names))


def changes(taken: DataFrame, held: DataFrame, metrics: list[Metric], replace: bool = True) -> DataFrame:
    """device_id, ts, key, sign and a column a metric: readings that come and go, of what ``arrived`` and what is ``held`` (``last``).

    ``replace``: a reading whose key is held takes the old one's place; without it the one
    held stays. Equal readings change nothing. The time is part of what a key names: a reading
    is looked up in the bin of its own time.
    """
    if any(m.monoid not in ("sum", "count") for m in metrics):
        raise ValueError("only sums and counts can be subtracted")
    names = _names(metrics)
    old = held.select(*READING, F.lit(True).alias("had"), *(F.col(n).alias(f"old_{n}") for n in names))
    both = taken.join(old, READING, "left").withColumn("had", F.coalesce("had", F.lit(False)))
    same = reduce(lambda c, n: c & F.col(n).eqNullSafe(F.col(f"old_{n}")), names, F.col("had") & F.col("comes"))
    stays = same | (F.col("had") & ~F.col("cleared") & ~(F.col("comes") & F.lit(replace)))
    side = lambda sign, prefix: F.struct(F.lit(sign).cast("long").alias("sign"), *(F.col(prefix + n).alias(n) for n in names))
    moves = F.array(F.when(F.col("had") & ~stays, side(-1, "old_")), F.when(F.col("comes") & ~stays, side(1, "")))
    return both.select("device_id", *READING, F.explode(F.array_compact(moves)).alias("c")).select("device_id", *READING, "c.*")


def moved(spark: SparkSession, path: str, metrics: list[Metric]) -> Versioned:
    """The changes of all batches, each with the time it was written (``at``, ms)."""
    values = ", ".join(f"{n} double" for n in _names(metrics))
    return Versioned(spark, f"{path}/moved", StructType.fromDDL(f"device_id long, ts long, key string, sign long, {values}, at long, day long, batch long"), ("day", "batch"))


def last(rows: DataFrame) -> DataFrame:
    """The readings that are held after ``rows`` of ``moved``: of a key's rows the last one, if it came."""
    rest, order = [c for c in rows.columns if c not in (*READING, "batch")], F.col("batch") * 4 + F.col("sign")
    return rows.groupBy(*READING).agg(*(F.max_by(c, order).alias(c) for c in rest)).where("sign > 0")


def table(spark: SparkSession, path: str, metrics: list[Metric]) -> Versioned:
    state = ", ".join(f"`{s}` {'long' if s.endswith('_n') else 'decimal(38,%d)' % _scale(m, s) if m.scale is not None else 'double'}" for m in metrics for s in m.state)
    return Versioned(spark, f"{path}/deltas", StructType.fromDDL(f"device_id long, ts long, readings long, {state}, day long, batch long"), ("day", "batch"))


def _scale(m: Metric, state: str) -> int:
    return 2 * m.scale if state.endswith("_sumsq") else m.scale


def _summed(rows: DataFrame, metrics: list[Metric], names: list[str]) -> DataFrame:
    """A batch's changes as differences of bins; bins whose changes cancel out have none."""
    sums = [F.sum("sign").alias("readings")]
    for m, n in zip(metrics, names):
        v = F.col(n) if m.scale is None else F.col(n).cast(f"decimal(18,{m.scale})")
        sums.append(F.sum(F.when(F.col(n).isNotNull(), F.col("sign")).otherwise(0)).alias(m.state[0]))
        for s, x in zip(m.state[1:], (v, v * v)):
            kind = "double" if m.scale is None else f"decimal(38,{_scale(m, s)})"
            sums.append(F.coalesce(F.sum(F.when(F.col("sign") > 0, x).otherwise(-x)).cast(kind), F.lit(0).cast(kind)).alias(s))
    return rows.groupBy("device_id", "ts").agg(*sums)


def _by_day(rows: DataFrame, batch_id: int) -> DataFrame:
    """Rows with their partitions, a day dealt by groups of devices."""
    return rows.withColumns({"day": _day(), "batch": F.lit(batch_id).cast("long")}).repartition("day", bucket_of())


def add(batch: DataFrame, batch_id: int, path: str, bin_: str, metrics: list[Metric], key: list[str], time: str, order: str, deleted: str | None = None, replace: bool = True, ttl_ms: int | None = None) -> None:
    """Commit a batch's changes and differences in the place of any that the same batch left.

    ``ttl_ms``: how long a reading is held. The days it touches reach the driver.
    """
    spark, now = batch.sparkSession, int(clock.time() * 1000)
    kept, own = moved(spark, path, metrics), F.col("batch") == batch_id
    at = f"{path}/_arrived/{uuid.uuid4().hex}"
    found = arrived(batch, bin_, metrics, key, time, order, deleted, replace)
    found.write.parquet(at)
    taken = spark.read.schema(found.schema).parquet(at)
    days = [r["day"] for r in taken.select(_day().alias("day")).distinct().collect()]
    before = kept.read().where(F.col("day").isin(days) & (F.col("batch") < batch_id))
    if ttl_ms is not None:
        before = before.where(F.col("at") > now - ttl_ms)
    held = last(before.join(taken.select(*READING), READING, "left_semi"))
    made = changes(taken, held, metrics, replace).withColumn("at", F.lit(now).cast("long"))
    kept.commit(_by_day(made, batch_id), replaced=own)
    sums = _summed(kept.read().where(own), metrics, _names(metrics))
    table(spark, path, metrics).commit(_by_day(sums, batch_id), replaced=own)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start within get the state store that keyed state needs; a query keeps the setting it starts with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, path: str, checkpoint: str, bin_: str, metrics: list[Metric], key: list[str], time: str = "timestamp", order: str = "timestamp", deleted: str | None = None, replace: bool = True, ttl_ms: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keep ``path`` up to date with the stream of readings, replacements and deletions."""
    each = lambda batch, batch_id: add(batch, batch_id, path, bin_, metrics, key, time, order, deleted, replace, ttl_ms)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _folded(rows: DataFrame, metrics: list[Metric]) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.groupBy("device_id", "ts").agg(F.sum("readings").alias("readings"), *(F.sum(s).cast(kinds[s]).alias(s) for m in metrics for s in m.state))


def current_bins(spark: SparkSession, path: str, metrics: list[Metric], days: tuple[int, int] | None = None) -> DataFrame:
    """The state of the bins that begin on the days [first, last) and have readings left, as a tier's."""
    rows = table(spark, path, metrics).read()
    if days is not None:
        rows = rows.where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
    left = _folded(rows, metrics).where("readings > 0")
    return left.select("device_id", "ts", *(F.col(s) if s.endswith("_n") else F.col(s).cast("double").alias(s) for m in metrics for s in m.state))


def fold(spark: SparkSession, path: str, metrics: list[Metric], upto: int, ttl_ms: int | None = None) -> int:
    """Sum the differences of the batches up to ``upto``, all of them done with, into one a bin, and keep one row a reading they left; the differences' version.

    Bins without readings go, and so do readings held for longer than ``ttl_ms``. A batch that may still be retried must not be folded.
    """
    done = F.col("batch") <= upto
    readings = moved(spark, path, metrics)
    version = readings.version()
    left = last(readings.read(version).where(done))
    if ttl_ms is not None:
        left = left.where(F.col("at") > int(clock.time() * 1000) - ttl_ms)
    readings.commit(_by_day(left, upto), replaced=done, expected=version)
    kept = table(spark, path, metrics)
    version = kept.version()
    rows = _folded(kept.read(version).where(done), metrics).where("readings > 0")
    return kept.commit(_by_day(rows, upto), replaced=done, expected=version)

"""Readings as a stream: merge, and rebuild of the tiers' bins that late data touch.

Late data are never dropped, so there is no watermark: each micro-batch finds the bins
it touches, and those bins are rebuilt from the deduplicated readings of the days that
hold them. Readings and bins are kept by day, so a batch reads what it touches and no
more, and ``compact`` folds a day's batches into one. Of readings with one key the one
stored first stays, as in ``operators.ingest.merge``; each row keeps the number of the batch
it came with (``seq``), so folded rows keep their places, and a batch that is sent again finds them.
``streaming.deltas`` keeps bins without summing days again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.durations import UNIT_MS
from ..functions.monoid import Metric
from ..functions.timeaxis import bin_end, epoch_ms, floor_bin
from ..operators.ingest import dedupe
from ..operators.rollup import aggregate_raw

DAY = UNIT_MS["d"]


def touched_bins(batch: DataFrame, bin_: str, time: str) -> DataFrame:
    return batch.select("device_id", floor_bin(epoch_ms(time), bin_).alias("ts")).distinct()


def _keep(rows: DataFrame, ms, batch_id: int, path: str) -> None:
    """Write rows by day and batch; a retried batch replaces its own files."""
    dealt = rows.withColumn("day", F.floor(ms / DAY)).withColumn("batch", F.lit(batch_id).cast("long"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One reading a key: of the earliest batch, in it the first by ``order``, of those that tie the least."""
    rest = [F.col(c) for c in sorted(rows.columns) if c not in (*key, "seq", "day", "batch")]
    return dedupe(rows, key, [F.col("seq"), F.col(order), *rest])


def _days_of(touched: DataFrame, bin_: str) -> list[int]:
    """The days that the touched bins reach over: as many as the batch has, on the driver."""
    first, last = F.floor(F.col("ts") / DAY), F.floor((bin_end(F.col("ts"), bin_) - 1) / DAY)
    return [r["day"] for r in touched.select("ts").distinct().select(F.explode(F.sequence(first, last)).alias("day")).distinct().collect()]


def _rebuild(spark: SparkSession, touched: DataFrame, batch_id: int, path: str, bin_: str, metrics: list[Metric], time: str, key: list[str], order: str) -> None:
    days = _days_of(touched, bin_)
    seen = spark.read.parquet(f"{path}/readings").where(F.col("day").isin(days))  # these days' folders alone
    near = seen.withColumn("ts", floor_bin(epoch_ms(time), bin_)).join(touched, ["device_id", "ts"], "left_semi").drop("ts")
    clean = _first(near.drop("batch", "day"), key, order)
    _keep(aggregate_raw(clean, bin_, metrics, time=time), F.col("ts"), batch_id, f"{path}/bins")


def merge_batch(batch: DataFrame, batch_id: int, path: str, bin_: str, metrics: list[Metric], time: str, key: list[str], order: str, best_effort: bool = False) -> None:
    """Add the batch to ``path``/readings, then write the touched bins' new state.

    Readings are safe before a bin is touched. With ``best_effort`` a failure of the second
    step doesn't stop the stream: the touched bins are noted, and ``repair`` builds them.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    _keep(batch.withColumn("seq", F.lit(batch_id).cast("long")), epoch_ms(time), batch_id, f"{path}/readings")
    touched = touched_bins(batch, bin_, time)
    try:
        _rebuild(spark, touched, batch_id, path, bin_, metrics, time, key, order)
    except Exception:
        if not best_effort:
            raise
        touched.write.mode("overwrite").parquet(f"{path}/failed/batch={batch_id}")


def repair(spark: SparkSession, path: str, bin_: str, metrics: list[Metric], time: str = "timestamp", key: list[str] = ["device_id", "timestamp"], order: str = "timestamp") -> bool:
    """Build the bins that a ``best_effort`` merge noted, from all readings so far; whether there were any."""
    from ..sources.files import read_or_empty, tier_schema

    failed = read_or_empty(spark, f"{path}/failed", tier_schema([]))
    if failed.isEmpty():
        return False
    last = spark.read.parquet(f"{path}/readings").agg(F.max("batch")).first()[0]
    _rebuild(spark, failed.distinct(), last, path, bin_, metrics, time, key, order)
    return True


def run(stream: DataFrame, path: str, checkpoint: str, bin_: str, metrics: list[Metric], time: str = "timestamp", key: list[str] = ["device_id", "timestamp"], order: str = "timestamp", trigger: dict | None = None, best_effort: bool = False) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, bin_, metrics, time, key, order, best_effort)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def current_bins(spark: SparkSession, path: str, metrics: list[Metric], days: tuple[int, int] | None = None) -> DataFrame:
    """The state of every bin that begins on the days [first, last): of the batches that wrote it, the last."""
    bins = spark.read.parquet(f"{path}/bins")
    if days is not None:
        bins = bins.where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
    return dedupe(bins.drop("day"), ["device_id", "ts"], [F.col("batch")], "last").drop("batch")


#: Where folded rows are kept: before any batch, so that no batch that is sent again replaces them.
FOLDED = -1


def compact(spark: SparkSession, path: str, days: tuple[int, int], key: list[str] = ["device_id", "timestamp"], order: str = "timestamp") -> None:
    """Fold the batches of each day of [first, last) into one: readings once a key, bins in their last state.

    The folded files come first; then the batches go. Between the two a reader sees rows
    twice, which both readers fold, so a failure costs nothing but a second run. No batch
    of these days may be written meanwhile; one that is sent again later finds its rows.
    """
    for name, fold in (("readings", lambda df: _first(df, key, order)), ("bins", lambda df: dedupe(df, ["device_id", "ts"], [F.col("batch")], "last"))):
        held = spark.read.parquet(f"{path}/{name}").where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
        batches = held.select("day", "batch").distinct().collect()  # folders, not rows
        several = {r["day"] for r in batches if r["batch"] != FOLDED}
        if not several:
            continue
        folded = fold(held.where(F.col("day").isin(sorted(several)))).withColumn("batch", F.lit(FOLDED).cast("long"))
        folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/{name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for r in batches:
            if r["batch"] != FOLDED:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"day={r['day']}/batch={r['batch']}"), True)


def tumbling(stream: DataFrame, time: str, width: str, values: dict[str, Callable], late: str | None = None) -> DataFrame:
    """Epoch-aligned tumbling windows in update mode: device_id, start and the named aggregates.

    With ``late`` a window is forgotten, and readings for it are dropped, once the stream is so
    far past its end; without it windows stay open, and their state, for as long as the stream runs.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark(time, late)
    window = F.window(F.col(time), width)
    return timed.groupBy("device_id", window.alias("w")).agg(*(f.alias(n) for n, f in values.items())).select("device_id", F.col("w.start").alias("start"), *values)


def unique(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once, forgotten after ``late`` (for sinks that can't merge)."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)

"""Roll-ups: readings to a tier, a tier to a coarser one, and pieces of a tier to one.

State is combined before the shuffle (partial aggregation), so a device with a third of
all readings costs a shuffle of its bins, not of its readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import Duration
from ..functions.monoid import Metric, coerce
from ..functions.timeaxis import epoch_ms, floor_bin

DEVICE, TS = "device_id", "ts"


def aggregate_raw(readings: DataFrame, bin_: str, metrics: list[Metric], dims: list[str] = [DEVICE], time: str = "timestamp") -> DataFrame:
    """dims, ts (bin start, ms) and the metrics' state; a bin without valid values keeps a row of zeros."""
    binned = readings.withColumn("_bin", floor_bin(epoch_ms(time), bin_))
    keys = [*(F.col(d) for d in dims), F.col("_bin").alias(TS)]
    listed = [m for m in metrics if m.listed]
    plain = [c for m in metrics if not m.listed for c in m.init()]
    out = binned.groupBy(*keys).agg(*plain) if plain else binned.select(*keys).distinct()
    return _joined(out, [listed_state(binned, dims, m) for m in listed], dims, metrics)


def _joined(out: DataFrame, lists: list[DataFrame], dims: list[str], metrics: list[Metric]) -> DataFrame:
    """Plain state and that of listed metrics, a row a key each, in one row; lists that a key lacks are empty."""
    if not lists:
        return out
    listed, state = [m for m in metrics if m.listed], [s for m in metrics for s in m.state]
    for part in lists:  # equal keys meet by grouping, so null dims do too
        out = out.unionByName(part, allowMissingColumns=True)
    merged = out.groupBy(*dims, TS).agg(*(F.first(s, ignorenulls=True).alias(s) for s in state))
    empty = {s: F.expr(f"cast({'map' if t.startswith('map') else 'array'}() as {t})") for m in listed for s, t in zip(m.state, m.state_types)}
    return merged.withColumns({s: F.coalesce(s, e) for s, e in empty.items()})


def listed_state(binned: DataFrame, dims: list[str], m: Metric) -> DataFrame:
    """dims, ts and the state of a topk, botk or histogram metric.

    Values are ranked, or counted by bucket, before any list is made, and Spark limits or
    combines them before the shuffle: a list has at most k values or the buckets in use.
    """
    rows = binned.select(*dims, F.col("_bin").alias(TS), coerce(F.expr(m.value)).alias("_v")).where("_v is not null")
    if m.monoid == "histogram":
        return _histogram(rows.select(*dims, TS, F.floor(F.col("_v") / m.width).cast("long").alias("key"), F.lit(1).cast("long").alias("value")), dims, m)
    return _best(rows, dims, m)


def _histogram(rows: DataFrame, dims: list[str], m: Metric) -> DataFrame:
    """Buckets' counts (key, value), added before they become a map: a list has the buckets in use."""
    counted = rows.groupBy(*dims, TS, "key").agg(F.sum("value").alias("value"))
    return counted.groupBy(*dims, TS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(m.state[0]))


def _best(rows: DataFrame, dims: list[str], m: Metric) -> DataFrame:
    """The k highest or lowest of the values ``_v``, ranked before they become a list."""
    up = m.monoid == "botk"
    rank = F.row_number().over(Window.partitionBy(*dims, TS).orderBy(F.col("_v") if up else F.desc("_v")))
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= m.k)
    return best.groupBy(*dims, TS).agg(F.sort_array(F.collect_list("_v"), up).alias(m.state[0]))


def merged(rows: DataFrame, metrics: list[Metric], dims: list[str]) -> DataFrame:
    """One row a key from rows with state: sums and sketches combine; lists and maps go value by value, so none grows beyond its k or its buckets."""
    plain, lists = [c for m in metrics if not m.listed for c in m.merge()], []
    out = rows.groupBy(*dims, TS).agg(*plain) if plain else rows.select(*dims, TS).distinct()
    for m in metrics:
        if m.monoid == "histogram":
            lists.append(_histogram(rows.select(*dims, TS, F.explode(m.state[0]).alias("key", "value")), dims, m))
        elif m.listed:
            lists.append(_best(rows.select(*dims, TS, F.explode(m.state[0]).alias("_v")), dims, m))
    return _joined(out, lists, dims, metrics)


def coarsen(state: DataFrame, source_bin: str, bin_: str, metrics: list[Metric], dims: list[str] = [DEVICE]) -> DataFrame:
    """A tier's state at a coarser bin; bins that don't divide are an error, as they would smear."""
    if not Duration.of(source_bin).divides(Duration.of(bin_)):
        raise ValueError(f"{source_bin} does not divide {bin_}")
    return merged(state.withColumn(TS, floor_bin(F.col(TS), bin_)), metrics, dims)


def stitch(pieces: list[DataFrame], metrics: list[Metric], dims: list[str] = [DEVICE]) -> DataFrame:
    """Pieces of one tier as one: equal bins merge."""
    if len(pieces) == 1:
        return pieces[0]
    columns = [*dims, TS, *(s for m in metrics for s in m.state)]
    whole = pieces[0].select(*columns)
    for p in pieces[1:]:
        whole = whole.unionByName(p.select(*columns))
    return merged(whole, metrics, dims)


def finalize(state: DataFrame, metrics: list[Metric], dims: list[str] = [DEVICE]) -> DataFrame:
    """dims, ts, and for each sum metric its count, mean and population deviation."""
    sums = [m for m in metrics if m.monoid == "sum"]
    return state.select(*dims, TS, *(c for m in sums for c in (F.col(m.state[0]), m.mean().alias(f"{m.name}_mean"), m.stddev().alias(f"{m.name}_stddev"))))


def state_columns(df: DataFrame) -> list[str]:
    """Columns that hold sum state, by suffix."""
    return [c for c in df.columns if c.endswith(("_n", "_sum", "_sumsq"))]

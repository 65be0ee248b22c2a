"""Sequence operators on time series that don't need a device in one task.

A plain window over a device sorts all its rows in one task. Here rows are windowed in
chunks of time; what crosses a chunk's edge is carried by one row a chunk (``previous``)
or by rows copied into the neighbour within the window's reach (``moving_sums``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def previous(df: DataFrame, order: str, keys: list[str], chunk: Column, out: str = "previous") -> DataFrame:
    """``df`` with ``out``: the largest earlier value of ``order`` within ``keys``, null at the first.

    ``chunk`` is a monotone coarsening of ``order``, such as its day. Rows with equal
    ``order`` see each other's value.
    """
    cut = df.withColumn("_chunk", chunk)
    inside = F.lag(order).over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    last = cut.groupBy(*keys, "_chunk").agg(F.max(order).alias("_last"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carried = last.select(*keys, "_chunk", F.lag("_last").over(by_chunk).alias("_carried"))
    joined = cut.withColumn("_inside", inside).join(carried, [*keys, "_chunk"])
    return joined.withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_chunk")


def moving_sums(df: DataFrame, at: str, keys: list[str], columns: dict[str, Column], before: int, after: int, chunk: int | None = None) -> DataFrame:
    """``df`` with the sum of each of ``columns`` over rows whose ``at`` is in [at - before, at + after].

    Rows are dealt by chunks of ``chunk`` units of ``at`` (64 window widths by default, a
    day at least); a row also visits the chunks that its reach meets, where it only adds.
    """
    width = chunk or max(64 * (before + after + 1), DAY_MS)
    own = F.floor(F.col(at) / width)
    visits = F.sequence(F.floor((F.col(at) - after) / width), F.floor((F.col(at) + before) / width))
    dealt = df.withColumn("_visit", F.explode(visits)).withColumn("_own", F.col("_visit") == own)
    window = Window.partitionBy(*keys, "_visit").orderBy(at).rangeBetween(-before, after)
    summed = dealt.select("*", *(F.sum(c).over(window).alias(n) for n, c in columns.items()))
    return summed.where("_own").drop("_own", "_visit")


def gaps(df: DataFrame, ms: str = "ms", keys: list[str] = ["device_id"]) -> DataFrame:
    """``df`` with previous_ms and gap_seconds, null at a device's first reading."""
    day = F.floor(F.col(ms) / DAY_MS)
    return previous(df, ms, keys, day, "previous_ms").withColumn("gap_seconds", (F.col(ms) - F.col("previous_ms")) / 1000.0)


def gap_markers(bins: DataFrame, width: int, values: list[str], keys: list[str] = ["device_id"], ts: str = "ts", count: str = "count", factor: int = 3) -> DataFrame:
    """``bins`` and a row of nulls with count 0 one width after a bin that more than ``factor`` widths follow."""
    near = previous(bins, ts, keys, F.floor(F.col(ts) / (1024 * width)), "_before")
    wide = near.where(F.col(ts) - F.col("_before") > factor * width)
    marks = wide.select(*keys, (F.col("_before") + width).alias(ts), F.lit(0).cast("long").alias(count), *(F.lit(None).cast(bins.schema[v].dataType).alias(v) for v in values))
    return bins.select(*keys, ts, count, *values).unionByName(marks)


def null_runs(df: DataFrame, value: str, keys: list[str], at: str, least: int = 1) -> DataFrame:
    """keys, run, start, end, points of each maximal run of rows with a value; runs under ``least`` points go.

    A run's number is the count of null rows before it, from sums by day.
    """
    cut = df.withColumn("_day", F.floor(F.col(at) / DAY_MS)).withColumn("_null", F.col(value).isNull().cast("long"))
    inside = Window.partitionBy(*keys, "_day").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    days = cut.groupBy(*keys, "_day").agg(F.sum("_null").alias("_nulls"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select(*keys, "_day", F.coalesce(F.sum("_nulls").over(before), F.lit(0)).alias("_offset"))
    numbered = cut.withColumn("_inside", F.sum("_null").over(inside)).join(offset, [*keys, "_day"]).withColumn("run", F.col("_inside") + F.col("_offset"))
    runs = numbered.where(F.col(value).isNotNull()).groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("points"))
    return runs.where(F.col("points") >= least)

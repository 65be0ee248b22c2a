"""Reports over readings, bins and registries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import floor_bin
from .series import gap_markers, gaps, moving_sums


def info(df: DataFrame, time: str = "timestamp", keys: list[str] = []) -> DataFrame:
    """records, earliest and latest, and the mean seconds between readings (null under two)."""
    span = (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.min(time).alias("earliest"), F.max(time).alias("latest"), F.when(F.count("*") > 1, span / (F.count("*") - 1)).alias("mean_interval"))


def monthly(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("records"), F.min(time).alias("earliest"), F.max(time).alias("latest"))


def daily(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("records"))


def top_gaps(df: DataFrame, k: int, keys: list[str] = ["device_id"], least: float | None = None) -> DataFrame:
    """The k longest gaps, ties to the smaller device and time."""
    found = gaps(df.select(*keys, "ms"), "ms", keys).where("gap_seconds is not null")
    if least is not None:
        found = found.where(F.col("gap_seconds") >= least)
    return found.orderBy(F.desc("gap_seconds"), *keys, "ms").limit(k)


def gap_totals(df: DataFrame, least: float, keys: list[str] = ["device_id"]) -> DataFrame:
    found = gaps(df.select(*keys, "ms"), "ms", keys).where(F.col("gap_seconds") >= least)
    return found.groupBy(*keys).agg(F.count("*").alias("gaps"), F.sum("gap_seconds").alias("seconds"))


def interval_drift(df: DataFrame, interval: float, keys: list[str] = ["device_id"]) -> DataFrame:
    """Intervals under, at and over the nominal one, their mean in seconds, and the rows it implies for a week."""
    g = F.col("gap_seconds")
    found = gaps(df.select(*keys, "ms"), "ms", keys).where(g.isNotNull())
    return found.groupBy(*keys).agg(F.count_if(g < interval).alias("under"), F.count_if(g == interval).alias("at"), F.count_if(g > interval).alias("over"), F.avg(g).alias("mean_seconds"), F.floor(F.lit(7 * 86_400.0) / F.avg(g)).alias("rows_a_week"))


def bounds(df: DataFrame, time: str, keys: list[str] = ["device_id"]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count("*").alias("records"))


def summary(per_device: DataFrame) -> DataFrame:
    return per_device.agg(F.count("*").alias("devices"), F.sum("records").alias("records"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def axis_bounds(df: DataFrame, mean: Column, spread: Column, keys: list[str], auto: bool = True, raw: Column | None = None) -> DataFrame:
    """Plot bounds over mean, mean ± spread and ``raw``: with 5 % margin, or from 0 where not ``auto``; equal bounds part by one.

    A null spread leaves the mean alone, null values count for nothing.
    """
    values = [mean, mean - spread, mean + spread, *([] if raw is None else [raw])]
    both = lambda pick: pick(*values) if len(values) > 1 else values[0]
    found = df.groupBy(*keys).agg(F.min(both(F.least)).alias("lo"), F.max(both(F.greatest)).alias("hi"))
    margin = (F.col("hi") - F.col("lo")) * 0.05 if auto else F.lit(0.0)
    low = F.col("lo") - margin if auto else F.least(F.lit(0.0), F.col("lo"))
    bounds_ = found.where(F.col("lo").isNotNull()).select(*keys, low.alias("y_min"), (F.col("hi") + margin).alias("y_max"))
    return bounds_.withColumn("y_max", F.when(F.col("y_max") == F.col("y_min"), F.col("y_min") + 1).otherwise(F.col("y_max")))


def chart_windows(df: DataFrame, minutes: int, value: str, keys: list[str] = ["device_id"], ms: str = "ms") -> DataFrame:
    """keys, ts, count, mean and stddev by windows of ``minutes``; a row of nulls where over three widths pass without one.

    Windows of a minute or less pass readings through: each its own row, deviation 0.
    """
    if minutes <= 1:
        return df.select(*keys, F.col(ms).alias("ts"), F.lit(1).cast("long").alias("count"), F.col(value).cast("double").alias("mean"), F.lit(0.0).alias("stddev"))
    width = minutes * 60_000
    bins = df.groupBy(*keys, floor_bin(F.col(ms), f"{minutes}min").alias("ts")).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    return gap_markers(bins, width, ["mean", "stddev"], keys)


def rolling(df: DataFrame, minutes: int, value: str, keys: list[str] = ["device_id"], ms: str = "ms") -> DataFrame:
    """``df`` with mean and stddev of ``value`` over the window of ``minutes`` centred on each reading; a minute or less: the value itself and 0."""
    if minutes <= 1:
        return df.withColumn("mean", F.col(value).cast("double")).withColumn("stddev", F.lit(0.0))
    half, v = minutes * 30_000, F.col(value).cast("double")
    summed = moving_sums(df, ms, keys, {"_n": F.col(value).isNotNull().cast("long"), "_sum": v, "_squares": v * v}, half, half)
    mean = F.col("_sum") / F.col("_n")
    variance = F.greatest(F.lit(0.0), F.col("_squares") / F.col("_n") - mean * mean)
    some = F.col("_n") > 0
    return summed.withColumn("mean", F.coalesce(F.when(some, mean), v)).withColumn("stddev", F.coalesce(F.when(some, F.sqrt(variance)), F.lit(0.0))).drop("_n", "_sum", "_squares")


def first_index(full_end: int, range_end: int | None, window_ms: int) -> int:
    """The place, from 1, of a table's first row among all windows, newest first; a range without an end is the latest."""
    return 1 if range_end is None else max(1, math.floor((full_end - range_end) / window_ms + 1 + 0.5))


def table_metadata(df: DataFrame, minutes: int, keys: list[str] = ["device_id"], ms: str = "ms") -> DataFrame:
    """keys, windows and minutes that a device's readings span, rounded up."""
    span = (F.max(ms) - F.min(ms)) / 60_000.0
    return df.groupBy(*keys).agg(F.ceil(span / minutes).alias("windows"), F.ceil(span).alias("minutes"))


def health(coverage_: DataFrame, rungs: DataFrame, tips: DataFrame) -> DataFrame:
    """One row a device and tier: its coverage, its rungs' statistics as a list, and when its newest raw file (device_id, uploaded) was written.

    ``badge``: the missing shards if any, else the pending ones, else complete.
    """
    listed = rungs.groupBy("device_id", "tier").agg(F.array_sort(F.collect_list(F.struct("rung", "shards", "last_written"))).alias("rungs"))
    latest = tips.groupBy("device_id").agg(F.max("uploaded").alias("uploaded"))
    missing = F.col("expected") - F.col("present") - F.col("pending")
    text = lambda n, word: F.concat(n.cast("string"), F.lit(word))
    badge = F.when(missing > 0, text(missing, " missing")).when(F.col("pending") > 0, text(F.col("pending"), " pending")).otherwise("complete")
    return coverage_.join(listed, ["device_id", "tier"], "left").join(latest, "device_id", "left").withColumn("badge", badge)


def input_bin_width(df: DataFrame, keys: list[str] = ["device_id"], ms: str = "ms", sample: int = 100, least: int = 10) -> DataFrame:
    """keys, width: the upper median of the positive steps between a device's first ``sample`` readings; none under ``least``.

    The limit to the first readings is the definition, not a sample of the result.
    """
    first = _first(df, keys, ms, sample)
    steps = F.filter(F.transform(F.sequence(F.lit(2), F.size("t")), lambda i: F.element_at("t", i) - F.element_at("t", i - 1)), lambda d: d > 0)
    found = first.where(F.size("t") >= least).withColumn("d", F.sort_array(steps)).where(F.size("d") > 0)
    return found.select(*keys, F.element_at("d", F.floor(F.size("d") / 2).cast("int") + 1).alias("width"))


def _first(df: DataFrame, keys: list[str], ms: str, n: int) -> DataFrame:
    """keys, t: the n smallest values, picked by a ranked window that Spark limits before the shuffle."""
    ranked = df.select(*keys, F.col(ms).alias("ms")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("ms"))).where(F.col("_r") <= n)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("ms")).alias("t"))


def table_page(bins: DataFrame, ts: str, page: int, size: int, keys: list[str], count: str = "count") -> DataFrame:
    """Rows of one page, newest first, without gap markers; ``index`` counts from 1."""
    real = bins.where(F.col(count) > 0)
    ordered = real.orderBy(F.desc(ts), *keys).offset(page * size).limit(size)
    return ordered.withColumn("index", F.row_number().over(Window.orderBy(F.desc(ts), *keys)).cast("long") + page * size)


def align(grid: DataFrame, smooth: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every grid row with the smoothed values of its key, nulls where there are none."""
    return grid.select(*keys).join(smooth.select(*keys, *values), keys, "left")


def device_names(df: DataFrame, devices: DataFrame) -> DataFrame:
    """``df`` with name from ``devices`` (device_id, name), else 'Device <id>'."""
    return df.join(devices.select("device_id", "name"), "device_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Device "), F.col("device_id").cast("string"))))


def resolve_device(devices: DataFrame, name_or_id: str) -> int:
    """One device by exact id, else by a case-blind pattern on the name; none or several is an error."""
    if name_or_id.isdigit():
        found = devices.where(F.col("device_id") == int(name_or_id))
    else:
        found = devices.where(F.col("name").rlike("(?i)" + name_or_id))
    rows = found.select("device_id").limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{name_or_id!r} names {'no device' if not rows else 'several devices'}")
    return rows[0]["device_id"]


def find_device(devices: DataFrame, pattern: str) -> int | None:
    """By id, then exact name, then a unique part of a name; None when that names none or several."""
    if pattern.isdigit() and (rows := devices.where(F.col("device_id") == int(pattern)).limit(1).collect()):
        return rows[0]["device_id"]
    name, low = F.lower("name"), pattern.lower()
    for match in (name == low, name.contains(low)):
        rows = devices.where(match).select("device_id").limit(2).collect()
        if len(rows) == 1:
            return rows[0]["device_id"]
    return None


def search(df: DataFrame, column: str, terms: list[str], order: list[str], offset: int = 0, limit: int = 50) -> tuple[DataFrame, int, bool]:
    """Rows that hold every term, one page of them, with the total and whether more follow."""
    found = df
    for t in terms:
        found = found.where(F.lower(column).contains(t.lower()))
    total = found.count()
    return found.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def rotation(devices: DataFrame, minute: int, id_: str = "device_id") -> DataFrame:
    """Devices with ``turn``: their place in a round robin that starts one further each minute.

    The list of devices is a small table; its order is one list of ids, not a window over rows.
    """
    order = devices.agg(F.array_sort(F.collect_set(id_)).alias("_order"))
    placed = order.select(F.posexplode("_order").alias("_i", "_id"), F.size("_order").alias("_n"))
    turn = F.pmod(F.col("_i") - F.lit(minute), F.col("_n")).cast("long")
    return devices.join(placed.select(F.col("_id").alias(id_), turn.alias("turn")), id_)


def fetch_trace(calls: DataFrame, by_key: bool = True) -> DataFrame:
    """Per key, or over all: calls, bytes and ms, bytes by phase, cached calls and their share; a key's first call (by seq) reads metadata, later ones data."""
    by = calls.groupBy("key").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"), F.sum("ms").alias("ms"), F.min_by("bytes", "seq").alias("meta_bytes"), F.count_if("cached").alias("cached"))
    if not by_key:
        by = by.agg(*(F.sum(c).alias(c) for c in ("calls", "bytes", "ms", "meta_bytes", "cached")))
    return by.withColumn("data_bytes", F.col("bytes") - F.col("meta_bytes")).withColumn("hit_share", F.col("cached") / F.col("calls"))

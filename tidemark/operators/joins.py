"""Joins on intervals, without a nested loop over all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Blocks are at most 2 ** TOP cells long; a longer span has several of that length.
TOP = 10


def blocks(start: Column, end: Column, width: int, top: int = TOP) -> tuple[Column, Column]:
    """The span [start, end) as arrays of (level, place): the fewest aligned blocks of 2 ** level cells that make it up, and the longer blocks that hold some of these but reach beyond the span.

    For a span of n cells these are at most 2 log n blocks each, and one for every 2 ** ``top``
    cells. Two spans meet in a cell just where a block of one is a block of the other, or one
    that holds some of the other's.
    """
    first, last = F.floor(start / width), F.floor((end - 1) / width) + 1
    own, over = [], []
    for level in range(top + 1):
        n = 1 << level
        lo, hi = F.ceil(first / n).cast("long"), F.floor(last / n).cast("long")
        place = lambda i, at=level: F.struct(F.lit(at).alias("level"), i.alias("place"))
        none = F.expr("cast(array() as array<struct<level: int, place: bigint>>)")
        if level == top:
            own.append(F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda i: place(i))).otherwise(none))
        else:
            own.append(F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), F.array(place(lo))).otherwise(none))
            own.append(F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1), F.array(place(hi - 1))).otherwise(none))
        if level:
            cut = lambda c, size=n: F.pmod(c, F.lit(size)) != 0
            over.append(F.when(cut(first), F.array(place(F.floor(first / n).cast("long")))).otherwise(none))
            over.append(F.when(cut(last), F.array(place(F.floor(last / n).cast("long")))).otherwise(none))
    return F.array_distinct(F.concat(*own)), F.array_distinct(F.concat(*over))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int, also: Column | None = None, left_span=("start", "end"), right_span=("r_start", "r_end"), best: tuple[Callable[[str], Column], str] | None = None) -> DataFrame:
    """Rows of ``left`` whose half-open span meets one of ``right`` (and ``also`` holds), each once.

    Rows with one span meet the same others, so distinct spans are joined: both sides are
    cut into aligned blocks of cells of ``width``, and the join is an equi-join on the block,
    however long the spans. ``best``, F.max or F.min and a column of ``right``, gives the value of the rows that a
    span meets which ``also`` compares, as ``_best``, with columns of ``left``; so a row costs
    one look-up, however many rows meet it. ``keys`` identify a left row.
    """
    if (also is None) != (best is None):
        raise ValueError("a condition needs what sums up the rows it is on")
    pick, column = best or (F.max, right_span[0])
    own_spans = left.where(F.col(left_span[0]) < F.col(left_span[1])).select(F.col(left_span[0]).alias("_start"), F.col(left_span[1]).alias("_end")).distinct()
    spans = right.where(F.col(right_span[0]) < F.col(right_span[1])).groupBy(F.col(right_span[0]).alias("_from"), F.col(right_span[1]).alias("_to"))
    others = spans.agg(pick(column).alias("_best"))
    own, over = blocks(F.col("_start"), F.col("_end"), width)
    there, beyond = blocks(F.col("_from"), F.col("_to"), width)
    sided = lambda side, places: F.transform(places, lambda p: F.struct(F.lit(side).alias("side"), p["level"].alias("level"), p["place"].alias("place")))
    a = own_spans.withColumn("_block", F.explode(F.concat(sided(0, own), sided(1, over))))
    b = others.withColumn("_block", F.explode(F.concat(sided(0, F.concat(there, beyond)), sided(1, there))))
    met = a.join(b, "_block").where((F.col("_start") < F.col("_to")) & (F.col("_end") > F.col("_from")))
    reach = met.groupBy("_start", "_end").agg(pick("_best").alias("_best"))
    found = left.join(reach, (left[left_span[0]] == reach["_start"]) & (left[left_span[1]] == reach["_end"]))
    return (found if also is None else found.where(also)).select(*(left[c] for c in left.columns))


def uncovered_days(devices: DataFrame, rows: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """device_id, day (ms): days of [start, end) of each device that no single row of ``rows`` (device_id, r_start, r_end) covers."""
    days = devices.select("device_id", F.explode(F.sequence(F.floor(F.col("start") / day_ms), F.floor((F.col("end") - 1) / day_ms))).alias("_day"))
    whole = rows.select("device_id", F.ceil(F.col("r_start") / day_ms).alias("_a"), (F.floor(F.col("r_end") / day_ms) - 1).alias("_b")).where("_a <= _b")
    covered = whole.select("device_id", F.explode(F.sequence("_a", "_b")).alias("_day")).distinct()
    return days.join(covered, ["device_id", "_day"], "left_anti").select("device_id", (F.col("_day") * day_ms).alias("day"))

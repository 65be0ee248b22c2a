"""Readings in: normal form, range filters, conflicts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.monoid import coerce

FIELDS = ["timestamp", "temp", "co2", "pm10", "pm25", "humid", "voc"]
VALUES = FIELDS[1:]


def normalize(df: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """The fields alone, in order: the first as a UTC timestamp, the rest as numbers or null; a missing one is an error."""
    return df.select(F.col(fields[0]).cast("timestamp").alias(fields[0]), *(coerce(F.col(f)).alias(f) for f in fields[1:]))


def between(time: Column, start=None, end=None) -> Column:
    """Inclusive range, as reports and charts filter; open at a missing end."""
    out = F.lit(True)
    if start is not None:
        out = out & (time >= start)
    if end is not None:
        out = out & (time <= end)
    return out


def half_open(time: Column, start, end) -> Column:
    """[start, end), as tiers filter."""
    return (time >= start) & (time < end)


def in_range(df: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Rows with ``time`` in [start, end) of epoch ms, compared in the column's own type, so that the scan gets the filter."""
    kind = df.schema[time].dataType
    at = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
    return df.where(half_open(F.col(time), at(start), at(end)))


def delete_range(df: DataFrame, time: str, start, end) -> DataFrame:
    """``df`` without the rows in the inclusive range; rows without a time stay."""
    return df.where(~F.coalesce(between(F.col(time), start, end), F.lit(False)))


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row a key: the first or last by ``order``.

    As an aggregate (min_by of a struct), not a window: it combines before the shuffle,
    so a key repeated a million times is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, variants (distinct rows), fields (names whose values differ, in order) where rows of a key differ.

    Null differs from a value. A field's values differ if the least isn't the greatest,
    which combines before the shuffle.
    """
    differs = lambda v: (F.min(v) < F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count("*")))
    found = df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("variants"), F.array_join(F.array_compact(F.array(*(F.when(differs(v), F.lit(v)) for v in values))), ",").alias("fields"))
    return found.where("variants > 1")


def outcomes(stored: DataFrame, new: DataFrame, keys: list[str], values: list[str], replace: bool = False) -> DataFrame:
    """Old and new readings, one a key, with ``added`` (the key wasn't stored) and ``differs`` (its readings differ, nulls from values too).

    One aggregate, which combines before the shuffle. Of new readings of one key the least by value counts.
    """
    columns = [*keys, *values]
    both = stored.select(*columns).withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    row, pick = F.struct(*values), F.max_by if replace else F.min_by
    held = both.groupBy(*keys).agg(pick(row, F.struct("_new", *values)).alias("_row"), (F.min("_new") == 1).alias("added"), (F.min(row) < F.max(row)).alias("differs"))
    return held.select(*keys, *(F.col(f"_row.{v}").alias(v) for v in values), "added", "differs")


def merge(stored: DataFrame, new: DataFrame, keys: list[str], values: list[str], on_conflict: str = "warn", seen: Observation | None = None) -> DataFrame:
    """Old and new readings, one a key.

    The stored one stays; ``replace`` takes the new one where the values differ; ``error``
    raises if any do. ``seen`` gets, from the job that uses the result, its ``rows`` and the
    ``conflicts``: keys whose readings differ.
    """
    out = outcomes(stored, new, keys, values, on_conflict == "replace")
    if on_conflict == "error" and out.where("differs").limit(1).count():
        raise ValueError("readings with equal keys differ")
    if seen is not None:
        out = out.observe(seen, F.count("*").alias("rows"), F.count_if("differs").alias("conflicts"))
    return out.drop("added", "differs")


def inserted(before: DataFrame, new: DataFrame, keys: list[str]) -> int:
    """How many keys of ``new`` are not in ``before``."""
    return new.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").count()

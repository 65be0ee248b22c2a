"""The time axis: epoch milliseconds, bins and period labels, as Columns and on the driver."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .durations import Duration

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LABELS = {"y": "%Y", "mo": "%Y-%m", "d": "%Y-%m-%d", "h": "%Y-%m-%dT%H", "min": "%Y-%m-%dT%H-%M"}
PATTERNS = {"y": "yyyy", "mo": "yyyy-MM", "d": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "min": "yyyy-MM-dd'T'HH-mm"}


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a timestamp, zoned or naive; naive ones mean UTC (the session zone must be UTC)."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def floor_bin(ms: Column, bin_: str | Duration) -> Column:
    """Start of the bin that holds ``ms``: epoch-aligned for fixed units, calendar-aligned for months and years."""
    d = Duration.of(bin_)
    if not d.is_calendar:
        return ms - F.pmod(ms, F.lit(d.ms))
    at = F.timestamp_millis(ms)
    months = F.year(at) * 12 + F.month(at) - 1
    first = months - F.pmod(months, F.lit(d.count)) if d.unit == "mo" else (F.year(at) - F.pmod(F.year(at), F.lit(d.count))) * 12
    date = F.make_date(F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)).cast("int") + 1, F.lit(1))
    return F.unix_millis(date.cast("timestamp"))


def bin_end(start: Column, bin_: str | Duration) -> Column:
    d = Duration.of(bin_)
    if not d.is_calendar:
        return start + d.ms
    return F.unix_millis(F.add_months(F.timestamp_millis(start).cast("date"), d.months).cast("timestamp"))


def bin_index(start: Column, bin_: str | Duration) -> Column:
    """The number of a bin by its start; neighbours differ by one."""
    d = Duration.of(bin_)
    if not d.is_calendar:
        return F.floor(start / d.ms)
    at = F.timestamp_millis(start)
    return F.floor((F.year(at) * 12 + F.month(at) - 1) / d.months)


def period_starts(start: Column, end: Column, bin_: str | Duration) -> Column:
    """An array of the starts of all bins that meet [start, end), in order; empty where the span is."""
    d, none = Duration.of(bin_), F.expr("cast(array() as array<bigint>)")
    if not d.is_calendar:
        return F.when(start < end, F.sequence(floor_bin(start, d), end - 1, F.lit(d.ms).cast("long"))).otherwise(none)
    day = lambda ms: F.timestamp_millis(floor_bin(ms, d)).cast("date")
    months = F.sequence(day(start), day(end - 1), F.make_ym_interval(F.lit(d.months // 12), F.lit(d.months % 12)))
    return F.when(start < end, F.transform(months, lambda m: F.unix_millis(m.cast("timestamp")))).otherwise(none)


def period_label(ms: Column, unit: str) -> Column:
    return F.date_format(F.timestamp_millis(ms), PATTERNS[unit])


# Driver side ---------------------------------------------------------------------------


def to_ms(at: datetime) -> int:
    return (at.replace(tzinfo=at.tzinfo or timezone.utc) - EPOCH) // timedelta(milliseconds=1)


def from_ms(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def _months(year: int, month: int) -> int:
    return to_ms(datetime(year + (month - 1) // 12, (month - 1) % 12 + 1, 1, tzinfo=timezone.utc))


def span_of(ms: int, rung: str | Duration) -> tuple[int, int]:
    """[start, end) of the rung's period that holds ``ms``."""
    d = Duration.of(rung)
    if not d.is_calendar:
        start = ms // d.ms * d.ms
        return start, start + d.ms
    at = from_ms(ms)
    if d.unit == "y":
        year = at.year // d.count * d.count
        return _months(year, 1), _months(year + d.count, 1)
    month = (at.month - 1) // d.count * d.count + 1
    return _months(at.year, month), _months(at.year, month + d.count)


def shift(start: int, bin_: str | Duration, n: int) -> int:
    """The start of the bin that is ``n`` bins after the one that begins at ``start``."""
    d = Duration.of(bin_)
    if not d.is_calendar:
        return start + n * d.ms
    at = from_ms(start)
    months = at.year * 12 + at.month - 1 + n * d.months
    return _months(months // 12, months % 12 + 1)


def ceil_bin(ms: int, bin_: str | Duration) -> int:
    """The first start of a bin at ``ms`` or later."""
    start, end = span_of(ms, bin_)
    return ms if start == ms else end


def bins_between(start: int, end: int, bin_: str | Duration) -> int:
    """How many bins meet [start, end)."""
    d = Duration.of(bin_)
    if not d.is_calendar:
        return -(-end // d.ms) - start // d.ms
    return len(periods_overlapping(start, end, d))


def label_of(ms: int, rung: str | Duration) -> str:
    return from_ms(ms).strftime(LABELS[Duration.of(rung).unit])


def parse_period(label: str, rung: str | Duration) -> tuple[int, int]:
    """[start, end) of the period that a label names; labels inside a period name it too."""
    d = Duration.of(rung)
    try:
        at = datetime.strptime(label, LABELS[d.unit]).replace(tzinfo=timezone.utc)
    except ValueError:
        raise ValueError(f"period {label!r} does not fit rung {d}") from None
    return span_of(to_ms(at), d)


def periods_overlapping(start: int, end: int, rung: str | Duration) -> list[tuple[int, int]]:
    """All periods of the rung that meet [start, end), in order."""
    out, at = [], start
    while at < end:
        out.append(span_of(at, rung))
        at = out[-1][1]
    return out



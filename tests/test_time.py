from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.durations import Duration
from tidemark.functions.timeaxis import bin_end, bin_index, bins_between, ceil_bin, floor_bin, label_of, parse_period, periods_overlapping, shift, span_of, to_ms
from tidemark.plans.cover import min_cover, tile

DAY = 86_400_000
utc = lambda *a: to_ms(datetime(*a, tzinfo=timezone.utc))


def test_durations():
    assert Duration.of("10min").ms == 600_000
    assert Duration.of("3mo").is_calendar
    assert not Duration.of("3min").divides(Duration.of("10min"))
    assert Duration.of("1d").divides(Duration.of("1mo"))
    for bad in ("", "0d", "5mo", "2w", "-1d"):
        with pytest.raises(ValueError):
            Duration.of(bad)
    order = [Duration.of(d).usual_ms for d in ("1min", "1d", "28d", "1mo", "32d", "3mo", "1y")]
    assert order == sorted(order)


def test_periods():
    assert parse_period("2026-05", "1mo") == (utc(2026, 5, 1), utc(2026, 6, 1))
    assert parse_period("2026-05", "3mo") == (utc(2026, 4, 1), utc(2026, 7, 1))
    assert parse_period("2026", "1y") == (utc(2026, 1, 1), utc(2027, 1, 1))
    assert parse_period("2026-05-24", "1d") == (utc(2026, 5, 24), utc(2026, 5, 25))
    start, end = parse_period("2026-05-24", "32d")
    assert end - start == 32 * DAY and start % (32 * DAY) == 0 and start <= utc(2026, 5, 24) < end
    with pytest.raises(ValueError):
        parse_period("2026", "1mo")
    months = periods_overlapping(utc(2023, 11, 15), utc(2024, 3, 1), "1mo")
    assert [label_of(s, "1mo") for s, _ in months] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert months[-1][1] == utc(2024, 3, 1)  # a leap February


def test_calendar_arithmetic():
    assert shift(utc(2024, 1, 1), "1mo", 14) == utc(2025, 3, 1) and shift(utc(2024, 1, 1), "3mo", -1) == utc(2023, 10, 1)
    assert shift(utc(2024, 1, 1), "6h", -1) == utc(2023, 12, 31, 18) and shift(utc(2024, 1, 1), "1y", -2) == utc(2022, 1, 1)
    assert ceil_bin(utc(2024, 2, 1), "1mo") == utc(2024, 2, 1) and ceil_bin(utc(2024, 2, 1) + 1, "1mo") == utc(2024, 3, 1)
    assert bins_between(utc(2024, 1, 31), utc(2024, 3, 2), "1mo") == 3 and bins_between(0, 3 * DAY + 1, "1d") == 4


def test_bin_numbers_are_neighbours(spark):
    for width in ("1mo", "3mo", "1y", "6h"):
        starts = [span_of(utc(1969, 1, 1), width)[0]]
        for _ in range(9):
            starts.append(shift(starts[-1], width, 1))
        found = spark.createDataFrame([(x,) for x in starts], "s long").select(bin_index(F.col("s"), width).alias("i")).collect()
        assert [r["i"] - found[0]["i"] for r in found] == list(range(10))


LADDERS = [["1d", "1mo"], ["1d", "4d", "32d"], ["4d", "32d", "128d"], ["16d", "128d", "512d"]]


@given(st.integers(0, 1_900_000_000), st.integers(0, 200_000_000), st.sampled_from(LADDERS))
@settings(max_examples=200, deadline=None)
def test_cover_is_contiguous(genesis, length, ladder):
    rungs = [Duration.of(r) for r in ladder]
    now = (genesis + length) * 1000
    slots = min_cover(rungs, genesis * 1000, now)
    at = genesis * 1000
    for s in slots:
        assert s.effective_start == at and s.end <= now
        at = s.end
    assert span_of(at, rungs[0])[1] > now or at >= now


def test_tile():
    assert tile(0, 4, [(0, 1), (1, 2), (2, 4), (0, 2)]) == [(0, 2), (2, 4)]
    assert tile(0, 4, [(0, 1), (2, 4)]) is None


@given(st.integers(-4_000_000_000_000, 4_000_000_000_000))
@settings(max_examples=15, deadline=None)
def test_floor_matches_driver(spark, ms):
    bins = ["3min", "2h", "32d", "1mo", "3mo", "1y"]
    row = spark.range(1).select(*(c for i, b in enumerate(bins) for c in (floor_bin(F.lit(ms), b).alias(f"s{i}"), bin_end(floor_bin(F.lit(ms), b), b).alias(f"e{i}")))).first()
    for i, b in enumerate(bins):
        assert (row[f"s{i}"], row[f"e{i}"]) == span_of(ms, b)


@pytest.mark.parametrize(
    "text,stamp,span",
    [(None, None, DAY), ("-3d", None, 3 * DAY), ("251123", (2025, 11, 23), DAY), ("251123T0432", (2025, 11, 23, 4, 32), DAY), ("251123-3d", (2025, 11, 23), 3 * DAY), ("251123T0432-1d3h", (2025, 11, 23, 4, 32), DAY + 3 * 3_600_000)],
)
def test_range_codes(text, stamp, span):
    r = codec.decode_range(text)
    assert r.duration == span and r.end == (stamp and datetime(*stamp, tzinfo=timezone.utc))
    assert codec.encode_range(r) == text


def test_range_prefixes():
    for text, want in (("25", (2025, 1, 1)), ("2511", (2025, 11, 1)), ("251123T04", (2025, 11, 23, 4))):
        assert codec.decode_range(text).end == datetime(*want, tzinfo=timezone.utc)


def test_flexible_dates(spark):
    cases = {"20250630": "2025-06-30T00:00:00", "250630": "2025-06-30T00:00:00", "250630T16": "2025-06-30T16:00:00", "20250630T1620": "2025-06-30T16:20:00", "250630T16:20": "2025-06-30T16:20:00", "20250630T16:20:05": "2025-06-30T16:20:05"}
    for text, want in cases.items():
        assert codec.parse_datetime(text) == want
    assert codec.parse_datetime("2025-06-30T16:20:05Z") == "2025-06-30T16:20:05Z"
    with pytest.raises(ValueError):
        codec.parse_datetime("june")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.date_format(codec.flexible_timestamp(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_amounts():
    assert codec.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert codec.nice_ticks(0, 12) == [0, 2, 4, 6, 8, 10, 12] and codec.nice_ticks(0, 40) == [0, 10, 20, 30, 40]
    assert codec.nice_ticks(-3, 3) == [-3, -2, -1, 0, 1, 2, 3] and codec.nice_ticks(5, 5) == [5]
    assert codec.target_points(None) == 300 and codec.target_points(4000) == 400 and codec.target_points(100) == 100
    assert codec.target_points(900, 4) == 225
    assert codec.chart_window(DAY, 300) == 5
    assert codec.split_url("s3://bucket/a/b.parquet") == ("bucket", "a/b.parquet")
    assert codec.round_span(61 * 60_000) == 60 * 60_000


def test_time_ticks():
    assert codec.time_ticks(1, DAY, 6) == [i * 3 * 3_600_000 for i in range(1, 8)]
    assert codec.time_ticks(0, 10 * 60_000, 9) == [i * 60_000 for i in range(10)]
    assert codec.time_ticks(5, 30 * DAY, 4) == [7 * DAY, 14 * DAY, 21 * DAY, 28 * DAY]


def test_ranges_and_months():
    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    start, end = codec.default_range(now)
    assert (now - start).days == 34 and (end - now).seconds == 600 and codec.default_range(now, now, now) == (now, now)
    assert [codec.month_label(now, b) for b in (0, 1, 3)] == ["2024-03", "2024-02", "2023-12"]
    assert codec.require_zone(now) == now
    with pytest.raises(ValueError):
        codec.require_zone(datetime(2024, 1, 1))


def test_url_codes():
    axes = codec.Axes
    for code, want in (("tcA", axes("temp", "co2", False, True)), ("h", axes("humid", None)), ("pvaA", axes("pm25", "voc", True, True)), (None, axes())):
        assert codec.decode_axes(code) == want and codec.encode_axes(want) == code
    assert codec.decode_axes("zc") == axes() and codec.decode_axes("tz") == axes("temp", None)
    assert codec.decode_floors("t32,c350,zz,h1.5,q3") == {"temp": 32, "co2": 350} and codec.encode_floors({"temp": 32, "co2": -5}) == "t32,c-5"
    assert codec.decode_floors(None) == {} and codec.encode_floors({}) is None
    for code in ("4px", "1h", "1d3h", None):
        assert codec.encode_grouping(codec.decode_grouping(code)) == code
    assert codec.decode_grouping("3px") == 1
    assert [codec.compact_minutes(m) for m in (0, 59, 60, 61, 1440, 1501, 3600)] == ["0m", "59m", "1h", "1h1m", "1d", "1d1h", "2d12h"]


def test_amounts_as_text(spark):
    def shown(f, values):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(f(F.col("v"))).collect()]

    assert shown(codec.human_bytes, [5.0, 1536.0, 3 * 2.0**20, None]) == ["5 B", "1.5 KiB", "3.0 MiB", "\u2014"]
    assert shown(codec.human_count, [7.0, 7.25, 512.0, 2500.0, 25_000.0, 2_500_000.0, None]) == ["7", "7.3", "512", "2.50k", "25k", "2.5M", "\u2014"]
    assert shown(codec.rounded_age, [2_499.0, 59_500.0, 5_400_000.0, 129_600_000.0, None]) == ["2s", "1m", "2h", "2d", "\u2014"]
    assert shown(codec.compact_age, [59_999.0, 61_000.0, 7_199_999.0, 3 * 86_400_000.0, None, -1.0]) == ["<1m", "1m", "1h", "3d", "\u2013", "\u2013"]
    assert shown(codec.human_duration, [0.0, 60_000.0, 90_060_000.0, 86_400_000.0]) == ["0m", "1m", "1d 1h 1m", "1d"]


def test_rounding_by_metric(spark):
    row = spark.createDataFrame([(21.25, 400.5, -0.5)], "t double, c double, v double").select(codec.round_metric(F.col("t"), "temp"), codec.round_metric(F.col("c"), "co2"), codec.round_metric(F.col("v"), "voc")).first()
    assert tuple(row) == (21.3, 401.0, 0.0)

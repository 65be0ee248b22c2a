"""Queries of the time-series operators over the driver's tables, and their SQL.

``events`` stand for readings: user_id is the device, ``value`` and the number ``k`` of
``props`` are metrics. Sums are exact decimals on both sides, so any order gives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec
from .functions.durations import Duration
from .functions.monoid import Metric
from .functions.timeaxis import bin_end, epoch_ms, floor_bin, period_label, to_ms
from .operators import analytics, devices, ingest, registry, rollup, series
from .plans import query as range_query
from .plans.pyramid import DEFAULT_TIERS, Pyramid, default_pyramid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VALUE = Metric("value", "value", scale=2)
K = Metric("k", "k", scale=0)
PYRAMID = default_pyramid([{"name": "value", "scale": 2}])
DAY = 86_400_000
GENESIS, NOW = 1_704_067_200_000, 1_718_409_600_000  # 2024-01-01, 2024-06-15
START, END = GENESIS + 4 * DAY, GENESIS + 11 * DAY


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def epoch_of(year: int) -> int:
    return to_ms(datetime(year, 1, 1))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(F.col("user_id").alias("device_id"), F.col("ts").alias("timestamp"), epoch_ms("ts").alias("ms"), "value", k.alias("k"), "event_type", "event_id")


READINGS = """readings AS (
  SELECT user_id AS device_id, ts AS timestamp, epoch_us(ts) // 1000 AS ms, value, event_type, event_id,
         TRY_CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)"""
V, VV = "CAST(value AS DECIMAL(18,2))", "CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2))"
STATE = f"count(value) AS value_n, coalesce(sum({V})::DOUBLE, 0) AS value_sum, coalesce(sum({VV})::DOUBLE, 0) AS value_sumsq"


def fixed(width: int, ms: str = "ms") -> str:
    return f"({ms} - (({ms} % {width}) + {width}) % {width})"


def tier_sql(width: int, where: str = "TRUE") -> str:
    return f"SELECT device_id, {fixed(width)} AS ts, {STATE} FROM readings WHERE {where} GROUP BY 1, 2"


# Tiers ---------------------------------------------------------------------------------


def _tier_query(tier: str) -> Query:
    return lambda spark, sf: range_query.build_tiers(PYRAMID, readings(spark, sf))[tier]


for _t in DEFAULT_TIERS:
    query(f"WITH {READINGS} {tier_sql(Duration.of(_t['bin']).ms)}", f"tier_{_t['name']}")(_tier_query(_t["name"]))


@query(f"WITH {READINGS} {tier_sql(DAY)}")
def tier_direct_d1(spark, sf):
    return rollup.aggregate_raw(readings(spark, sf), "1d", [VALUE])


FINAL = "value_n, CASE WHEN value_n > 0 THEN value_sum / value_n END AS value_mean, CASE WHEN value_n > 0 THEN sqrt(greatest(0.0, value_sumsq / value_n - (value_sum / value_n) * (value_sum / value_n))) END AS value_stddev"


@query(f"WITH {READINGS}, t AS ({tier_sql(DAY)}) SELECT device_id, ts, {FINAL} FROM t")
def tier_mean_stddev(spark, sf):
    return rollup.finalize(rollup.aggregate_raw(readings(spark, sf), "1d", [VALUE]), [VALUE])


@query(f"""WITH {READINGS} SELECT device_id, {fixed(7_200_000)} AS ts, {STATE}, count(k) AS k_n, coalesce(sum(k)::DOUBLE, 0) AS k_sum,
  coalesce(sum(k * k)::DOUBLE, 0) AS k_sumsq FROM readings GROUP BY 1, 2""")
def tier_multi_metric_json(spark, sf):
    return rollup.aggregate_raw(readings(spark, sf), "2h", [VALUE, K])


@query(f"WITH {READINGS} SELECT event_type, {fixed(21_600_000)} AS ts, {STATE} FROM readings GROUP BY 1, 2")
def tier_by_event_type(spark, sf):
    return rollup.aggregate_raw(readings(spark, sf), "6h", [VALUE], dims=["event_type"])


PRICE = Metric("price", "o_totalprice", scale=2)


def _orders(bin_: str) -> Query:
    return lambda spark, sf: rollup.aggregate_raw(load(spark, sf, "orders"), bin_, [PRICE], dims=["o_orderstatus"], time="o_orderdate")


for _name, _bin, _trunc in (("tier_month", "1mo", "month"), ("tier_quarter", "3mo", "quarter"), ("tier_year", "1y", "year")):
    _p = "CAST(o_totalprice AS DECIMAL(18,2))"
    query(f"SELECT o_orderstatus, epoch_ms(date_trunc('{_trunc}', o_orderdate)::TIMESTAMP) AS ts, count(o_totalprice) AS price_n, sum({_p})::DOUBLE AS price_sum, sum({_p} * {_p})::DOUBLE AS price_sumsq FROM orders GROUP BY 1, 2", _name)(_orders(_bin))

LINE = [Metric(m, f"l_{c}", scale=2) for m, c in (("quantity", "quantity"), ("price", "extendedprice"), ("discount", "discount"), ("tax", "tax"))]
_line = ", ".join(f"count(l_{c}) AS {m}_n, sum(CAST(l_{c} AS DECIMAL(18,2)))::DOUBLE AS {m}_sum, sum(CAST(l_{c} AS DECIMAL(18,2)) * CAST(l_{c} AS DECIMAL(18,2)))::DOUBLE AS {m}_sumsq" for m, c in (("quantity", "quantity"), ("price", "extendedprice"), ("discount", "discount"), ("tax", "tax")))


@query(f"SELECT l_returnflag, l_linestatus, {fixed(32 * DAY, 'epoch_ms(l_shipdate)')} AS ts, {_line} FROM lineitem GROUP BY 1, 2, 3")
def tier_lineitem_32d(spark, sf):
    return rollup.aggregate_raw(load(spark, sf, "lineitem"), "32d", LINE, dims=["l_returnflag", "l_linestatus"], time="l_shipdate")


@query(f"WITH {READINGS} SELECT {fixed(DAY)} AS ts, count(DISTINCT device_id) AS devices FROM readings GROUP BY 1")
def tier_distinct_exact(spark, sf):
    return readings(spark, sf).groupBy(floor_bin(F.col("ms"), "1d").alias("ts")).agg(F.count_distinct("device_id").alias("devices"))


@query(f"WITH {READINGS} SELECT device_id, {fixed(DAY)} AS ts, count(DISTINCT event_id) AS exact_n, TRUE AS within FROM readings GROUP BY 1, 2")
def tier_hll(spark, sf):
    """Distinct event ids a device and day, and whether the sketch's estimate is within 5 % of them (or one)."""
    m = Metric("event", "event_id", "hll")
    day = rollup.coarsen(rollup.aggregate_raw(readings(spark, sf), "6h", [m]), "6h", "1d", [m])
    exact = readings(spark, sf).groupBy("device_id", floor_bin(F.col("ms"), "1d").alias("ts")).agg(F.count_distinct("event_id").alias("exact_n"))
    close = F.abs(F.hll_sketch_estimate("event_hll") - F.col("exact_n")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact_n"))
    return day.join(exact, ["device_id", "ts"]).select("device_id", "ts", "exact_n", close.alias("within"))


@query(f"WITH {READINGS}, t AS (SELECT device_id, {fixed(DAY)} AS ts, list(value ORDER BY value DESC)[:3] AS top, list(value ORDER BY value)[:3] AS low FROM readings GROUP BY 1, 2) SELECT device_id, ts, array_to_string(top, ' ') AS top, array_to_string(low, ' ') AS low FROM t")
def tier_top_values(spark, sf):
    """The three highest and lowest values a day, merged from six-hour lists."""
    metrics = [Metric("value", "value", "topk", k=3), Metric("low", "value", "botk", k=3)]
    day = rollup.coarsen(rollup.aggregate_raw(readings(spark, sf), "6h", metrics), "6h", "1d", metrics)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.regexp_replace(v.cast("string"), r"\\.0$", ".0")), " ")
    return day.select("device_id", "ts", text("value_topk").alias("top"), text("low_botk").alias("low"))


@query(f"WITH {READINGS} SELECT device_id, {fixed(DAY)} AS ts, CAST(floor(value / 50) AS BIGINT) AS bucket, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def tier_histogram(spark, sf):
    """Counts of values by buckets of 50 a day, merged from six-hour maps."""
    m = Metric("value", "value", "histogram", width=50.0)
    day = rollup.coarsen(rollup.aggregate_raw(readings(spark, sf), "6h", [m]), "6h", "1d", [m])
    return day.select("device_id", "ts", F.explode("value_histogram").alias("bucket", "n"))


@query(f"WITH {READINGS} SELECT device_id, {fixed(DAY)} AS ts, count(value) AS exact_n, TRUE AS within FROM readings GROUP BY 1, 2")
def tier_quantile(spark, sf):
    """The median of a device and day by sketch, and whether the share of readings up to it is within 5 % of a half (or a reading of it)."""
    m = Metric("value", "value", "quantile")
    day = rollup.coarsen(rollup.aggregate_raw(readings(spark, sf), "6h", [m]), "6h", "1d", [m])
    median = day.select("device_id", "ts", F.kll_sketch_get_quantile_double("value_quantile", F.lit(0.5)).alias("median"))
    own = readings(spark, sf).select("device_id", floor_bin(F.col("ms"), "1d").alias("ts"), "value").join(median, ["device_id", "ts"])
    counts = own.groupBy("device_id", "ts").agg(F.count("value").alias("exact_n"), F.count_if(F.col("value") < F.col("median")).alias("under"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    slack = F.greatest(F.lit(1.0), 0.05 * F.col("exact_n"))
    return counts.select("device_id", "ts", "exact_n", ((F.col("under") - slack <= F.col("exact_n") / 2) & (F.col("upto") + slack >= F.col("exact_n") / 2)).alias("within"))


CHAIN = Pyramid.of({"metrics": [{"name": "price", "value": "o_totalprice", "scale": 2}], "dims": [{"name": "device_id"}], "tiers": [{"name": "day", "bin": "1d", "shards": ["1mo"]}, {"name": "month", "bin": "1mo", "shards": ["1y"]}, {"name": "year", "bin": "1y", "shards": ["10y"]}]})


def _priced(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("device_id"), F.col("o_orderdate").alias("timestamp"), "o_totalprice")


def _chain_sql(trunc: str, where: str = "TRUE") -> str:
    p = "CAST(o_totalprice AS DECIMAL(18,2))"
    return f"SELECT o_custkey % 20 AS device_id, epoch_ms(date_trunc('{trunc}', o_orderdate)::TIMESTAMP) AS ts, count(o_totalprice) AS price_n, sum({p})::DOUBLE AS price_sum, round(sum({p} * {p})::DOUBLE, -2) AS price_sumsq FROM orders WHERE {where} GROUP BY 1, 2"


def _coarse_squares(rows: DataFrame) -> DataFrame:
    """Squares of prices have more digits than a double keeps from tier to tier."""
    return rows.withColumn("price_sumsq", F.round("price_sumsq", -2))


@query(_chain_sql("year"))
def tier_chain_month(spark, sf):
    """Days to months to years, written and read back a tier at a time."""
    from .plans import build

    path = _scratch(spark, "calendar")
    build.backfill(CHAIN, _priced(spark, sf), path)
    return _coarse_squares(build.tier(CHAIN, spark, path, "year"))


_FROM, _TO = 801_000_000_000, 901_000_000_000  # 1995-05-20 to 1998-07-21


@query(f"WITH t AS ({_chain_sql('month')}) SELECT * FROM t WHERE ts >= epoch_ms(TIMESTAMP '1995-05-01') AND ts < {_TO}")
def plan_calendar(spark, sf):
    """A range of three years in 60 bins, from month tiers."""
    plan = range_query.plan_query(CHAIN, _FROM, _TO, 60, {})
    return _coarse_squares(range_query.execute(plan, CHAIN, range_query.build_tiers(CHAIN, _priced(spark, sf)), _FROM, _TO))


# Range queries ---------------------------------------------------------------------------


def _planned(spark, sf, plan: range_query.QueryPlan) -> dict[str, DataFrame]:
    """The tiers over the plan's span, which reaches the scan of the readings."""
    lo, hi = min(x.start for x in plan.segments), max(x.end for x in plan.segments)
    return range_query.build_tiers(PYRAMID, ingest.in_range(readings(spark, sf), "timestamp", lo, hi))


def _budget(budget: int, smooth=None, mode="centered") -> Query:
    def run(spark, sf):
        plan = range_query.plan_query(PYRAMID, START, END, budget, {}, smooth, mode)
        return range_query.execute(plan, PYRAMID, _planned(spark, sf, plan), START, END)

    return run


for _budget_bins in (10, 50, 200, 1000, 50_000):
    _w = PYRAMID.tier(range_query.choose_tier(PYRAMID, END - START, _budget_bins)).bin.ms
    query(f"WITH {READINGS}, t AS ({tier_sql(_w)}) SELECT * FROM t WHERE ts >= {START // _w * _w} AND ts < {END}", f"plan_budget_{_budget_bins}")(_budget(_budget_bins))


@query(f"WITH {READINGS}, t AS ({tier_sql(21_600_000)}) SELECT * FROM t WHERE ts >= {START} AND ts < {END}")
def splice_tail(spark, sf):
    """The 6 h tier is fresh to the middle of the range; the rest comes from the 2 h tier."""
    cut = START + 3 * DAY + 5_000_000
    plan = range_query.plan_query(PYRAMID, START, END, 30, {"h6": cut})
    tiers = _planned(spark, sf, plan)
    held = tiers | {"h6": tiers["h6"].where(F.col("ts") + 21_600_000 <= cut)}
    return range_query.execute(plan, PYRAMID, held, START, END)


@query(f"WITH {READINGS}, t AS ({tier_sql(21_600_000)}) SELECT * FROM t WHERE (ts >= {START} AND ts < {START + 3 * DAY}) OR (ts >= {START + 4 * DAY} AND ts < {END})")
def inventory_plan(spark, sf):
    """Shards of three tiers with a day that none has."""
    shards = [("h6", "16d", START - DAY, START + 2 * DAY + 10_000_000), ("h2", "16d", START, START + 3 * DAY), ("m30", "4d", START + 4 * DAY, START + 6 * DAY), ("h2", "16d", START + 5 * DAY, END + DAY)]
    plan = range_query.plan_from_inventory(PYRAMID, START, END, 30, shards)
    return range_query.execute(plan, PYRAMID, _planned(spark, sf, plan), START, END)


_FLEET = f"device_id % 3 <> 2 OR ms < {START + 2 * DAY} OR ms >= {START + 3 * DAY}"


@query(f"WITH {READINGS}, t AS ({tier_sql(DAY, _FLEET)}) SELECT * FROM t WHERE ts >= {START} AND ts < {END}")
def inventory_plan_fleet(spark, sf):
    """Devices with different shards: days alone; days, then six hours, then minutes; minutes alone, with a day that none has."""
    shards = [(0, "d1", "32d", START - DAY, END + DAY), (1, "d1", "32d", START - 4 * DAY, START + 3 * DAY), (1, "h6", "16d", START, START + 5 * DAY)]
    shards += [(k, "raw", "1d", d, d + DAY) for k in (1, 2) for d in range(START, END, DAY) if (k, d) != (2, START + 2 * DAY)]
    kinds = spark.createDataFrame(shards, "kind int, tier string, rung string, period_start long, period_end long")
    fleet = readings(spark, sf).select("device_id", (F.col("device_id") % 3).cast("int").alias("kind")).distinct()
    chain = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], "tiers": [{"name": "raw", "bin": "1min", "shards": ["1d"]}, {"name": "h6", "bin": "6h", "shards": ["16d"]}, {"name": "d1", "bin": "1d", "shards": ["32d"]}]})
    plan, segments = range_query.plan_fleet(chain, fleet.join(kinds, "kind"), START, END, 10)
    return range_query.execute_fleet(plan, segments, chain, range_query.build_tiers(chain, readings(spark, sf)), START, END)


def smooth_sql(width: int, before: int, after: int) -> str:
    parts = ", ".join(f"sum(value_{s}) OVER w AS value_smooth_{s}" for s in ("sum", "sumsq"))
    lo, hi = START // width * width, -(-END // width) * width
    return f"""WITH {READINGS}, t AS ({tier_sql(width)}), r AS (SELECT * FROM t WHERE ts >= {lo - before} AND ts < {hi + after}),
s AS (SELECT *, CAST(sum(value_n) OVER w AS BIGINT) AS value_smooth_n, {parts} FROM r
 WINDOW w AS (PARTITION BY device_id ORDER BY ts RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING))
SELECT device_id, ts, value_n, round(value_sum, 4) AS value_sum, round(value_sumsq, 4) AS value_sumsq, value_smooth_n, round(value_smooth_sum, 4) AS value_smooth_sum,
 round(value_smooth_sumsq, 4) AS value_smooth_sumsq FROM s WHERE ts >= {lo} AND ts < {END}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(smooth_sql(7_200_000, 14_400_000, 14_400_000))
def smooth_centered(spark, sf):
    return _rounded(_budget(100, "10h")(spark, sf))


@query(smooth_sql(7_200_000, 36_000_000, 0))
def smooth_trailing(spark, sf):
    return _rounded(_budget(100, "12h", "trailing")(spark, sf))


@query(f"""WITH {READINGS} SELECT device_id, event_id, ms, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM readings
 WINDOW w AS (PARTITION BY device_id ORDER BY ms RANGE BETWEEN 1800000 PRECEDING AND 1800000 FOLLOWING)""")
def rolling_raw_1h(spark, sf):
    v = F.col("value").cast("decimal(18,2)")
    rows = readings(spark, sf).select("device_id", "event_id", "ms", v.alias("v"))
    out = series.moving_sums(rows, "ms", ["device_id"], {"n": F.lit(1), "total": F.col("v")}, 1_800_000, 1_800_000)
    return out.select("device_id", "event_id", "ms", F.col("n").cast("long").alias("n"), F.round(F.col("total").cast("double"), 4).alias("total"))


@query(f"WITH {READINGS}, t AS ({tier_sql(60_000)}) SELECT * FROM t WHERE ts >= {START} AND ts < {END} AND device_id IN (3, 7, 11)")
def pruned_scan(spark, sf):
    rows = ingest.in_range(readings(spark, sf), "timestamp", START, END).where(F.col("device_id").isin(3, 7, 11))
    return rollup.aggregate_raw(rows, "1min", [VALUE])


@query(f"""WITH {READINGS} SELECT device_id, event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS stddev FROM readings
 WINDOW w AS (PARTITION BY device_id ORDER BY ms RANGE BETWEEN 1800000 PRECEDING AND 1800000 FOLLOWING)""")
def rolling_stddev(spark, sf):
    out = analytics.rolling(readings(spark, sf), 60, "value")
    return out.select("device_id", "event_id", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


# Reports ---------------------------------------------------------------------------------


@query(f"WITH {READINGS} SELECT device_id, count(*) AS records, min(ms) AS earliest, max(ms) AS latest, CASE WHEN count(*) > 1 THEN ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) / (count(*) - 1) END AS mean_interval FROM readings GROUP BY 1")
def data_info(spark, sf):
    out = analytics.info(readings(spark, sf), keys=["device_id"])
    return out.select("device_id", "records", epoch_ms("earliest").alias("earliest"), epoch_ms("latest").alias("latest"), "mean_interval")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS records, epoch_ms(min(o_orderdate)) AS earliest, epoch_ms(max(o_orderdate)) AS latest FROM orders GROUP BY 1")
def data_info_monthly(spark, sf):
    out = analytics.monthly(load(spark, sf, "orders"), "o_orderdate")
    return out.select("month", "records", epoch_ms("earliest").alias("earliest"), epoch_ms("latest").alias("latest"))


@query("SELECT CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day, count(*) AS records FROM events GROUP BY 1")
def data_hist(spark, sf):
    return analytics.daily(readings(spark, sf)).select(F.col("day").cast("string").alias("day"), "records")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS records FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' GROUP BY 1")
def data_hist_range(spark, sf):
    rows = readings(spark, sf).where(ingest.between(F.col("timestamp"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")))
    return analytics.daily(rows).select(F.col("day").cast("string").alias("day"), "records")


GAPS = f"{READINGS}, g AS (SELECT device_id, ms, (ms - lag(ms) OVER (PARTITION BY device_id ORDER BY ms)) / 1000.0::DOUBLE AS gap_seconds FROM readings)"


@query(f"WITH {GAPS} SELECT device_id, ms, gap_seconds FROM g WHERE gap_seconds IS NOT NULL ORDER BY gap_seconds DESC, device_id, ms LIMIT 10")
def data_gaps_topk(spark, sf):
    return analytics.top_gaps(readings(spark, sf), 10).select("device_id", "ms", "gap_seconds")


@query(f"WITH {GAPS} SELECT device_id, count(*) AS gaps, round(sum(gap_seconds), 3) AS seconds FROM g WHERE gap_seconds >= 1200 GROUP BY 1")
def data_gaps_min(spark, sf):
    return analytics.gap_totals(readings(spark, sf), 1200.0).withColumn("seconds", F.round("seconds", 3))


@query(f"WITH {GAPS} SELECT device_id, ms, gap_seconds FROM g")
def gaps_all(spark, sf):
    return series.gaps(readings(spark, sf).select("device_id", "ms")).select("device_id", "ms", "gap_seconds")


@query(f'WITH {GAPS} SELECT device_id, count(*) FILTER (WHERE gap_seconds < 3600) AS under, count(*) FILTER (WHERE gap_seconds = 3600) AS "at", count(*) FILTER (WHERE gap_seconds > 3600) AS over, round(avg(gap_seconds), 3) AS mean_seconds, CAST(floor(604800.0 / avg(gap_seconds)) AS BIGINT) AS rows_a_week FROM g WHERE gap_seconds IS NOT NULL GROUP BY 1')
def interval_drift(spark, sf):
    return analytics.interval_drift(readings(spark, sf), 3600.0).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query(f"WITH {READINGS} SELECT device_id, min(ms) AS earliest, max(ms) AS latest, count(*) AS records FROM readings GROUP BY 1")
def bounds(spark, sf):
    return analytics.bounds(readings(spark, sf), "ms")


@query("SELECT user_id AS device_id, arg_max(event_id, (ts, event_id)) AS event_id, epoch_us(max(ts)) // 1000 AS latest FROM events GROUP BY 1")
def latest_per_device(spark, sf):
    r = readings(spark, sf)
    return r.groupBy("device_id").agg(F.max_by("event_id", F.struct("timestamp", "event_id")).alias("event_id"), F.max("ms").alias("latest"))


@query(f"WITH {READINGS}, d AS (SELECT device_id, min(ms) AS earliest, max(ms) AS latest, count(*) AS records FROM readings GROUP BY 1) SELECT count(*) AS devices, sum(records)::BIGINT AS records, min(earliest) AS earliest, max(latest) AS latest FROM d")
def summary_all(spark, sf):
    return analytics.summary(analytics.bounds(readings(spark, sf), "ms"))


@query(f"WITH {READINGS} SELECT device_id, min(ms) - (min(ms) % 60000) AS genesis FROM readings GROUP BY 1")
def genesis(spark, sf):
    return readings(spark, sf).groupBy("device_id").agg(F.min("ms").alias("m")).select("device_id", floor_bin(F.col("m"), "1min").alias("genesis"))


BINS = f"{READINGS}, b AS (SELECT device_id, {fixed(7_200_000)} AS ts, count(*) AS count, sum({V})::DOUBLE / count(*) AS mean FROM readings GROUP BY 1, 2)"


def _bins(spark, sf) -> DataFrame:
    t = rollup.aggregate_raw(readings(spark, sf), "2h", [VALUE])
    return t.select("device_id", "ts", F.col("value_n").alias("count"), VALUE.mean().alias("mean"))


MARKED = f"{BINS}, m AS (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY ts) AS before FROM b), g AS (SELECT device_id, ts, count, mean FROM b UNION ALL SELECT device_id, before + 7200000, 0, NULL FROM m WHERE ts - before > 21600000)"


@query(f"WITH {MARKED} SELECT * FROM g")
def gap_markers(spark, sf):
    return series.gap_markers(_bins(spark, sf), 7_200_000, ["mean"])


@query(f"""WITH {MARKED}, r AS (SELECT *, sum(CASE WHEN mean IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts) AS run FROM g)
SELECT device_id, CAST(run AS BIGINT) AS run, min(ts) AS start, max(ts) AS "end", count(*) AS points FROM r WHERE mean IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def null_run_segments(spark, sf):
    return series.null_runs(gap_markers(spark, sf), "mean", ["device_id"], "ts", 2)


@query(f"WITH {BINS}, o AS (SELECT *, row_number() OVER (ORDER BY ts DESC, device_id) AS index FROM b) SELECT device_id, ts, count, mean, index FROM o WHERE index > 40 AND index <= 60")
def table_page(spark, sf):
    return analytics.table_page(_bins(spark, sf), "ts", 2, 20, ["device_id"])


@query(f"""WITH {READINGS}, t AS ({tier_sql(DAY)}), f AS (SELECT device_id, ts, {FINAL} FROM t), x AS (SELECT device_id, min(value_mean - value_stddev) AS lo, max(value_mean + value_stddev) AS hi FROM f GROUP BY 1)
SELECT device_id, lo - (hi - lo) * 0.05::DOUBLE AS y_min, CASE WHEN hi = lo THEN hi + 1 ELSE hi + (hi - lo) * 0.05::DOUBLE END AS y_max FROM x""")
def axis_bounds(spark, sf):
    return analytics.axis_bounds(tier_mean_stddev(spark, sf), F.col("value_mean"), F.col("value_stddev"), ["device_id"])


@query(f"""WITH {READINGS}, t AS ({tier_sql(DAY)}), f AS (SELECT device_id, ts, {FINAL} FROM t), x AS (SELECT device_id, least(min(value_mean), min(value_mean - value_stddev)) AS lo, greatest(max(value_mean), max(value_mean + value_stddev)) AS hi FROM f GROUP BY 1)
SELECT device_id, least(0.0::DOUBLE, lo) AS y_min, CASE WHEN hi = least(0.0::DOUBLE, lo) THEN least(0.0::DOUBLE, lo) + 1 ELSE hi END AS y_max FROM x""")
def axis_bounds_from_zero(spark, sf):
    return analytics.axis_bounds(tier_mean_stddev(spark, sf), F.col("value_mean"), F.col("value_stddev"), ["device_id"], auto=False)


@query(f"WITH {READINGS}, b AS (SELECT device_id, {fixed(1_800_000)} AS ts, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev FROM readings GROUP BY 1, 2), m AS (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY ts) AS before FROM b) SELECT device_id, ts, count, mean, stddev FROM b UNION ALL SELECT device_id, before + 1800000, 0, NULL, NULL FROM m WHERE ts - before > 5400000")
def chart_windows(spark, sf):
    out = analytics.chart_windows(readings(spark, sf), 30, "value")
    return out.select("device_id", "ts", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query(f"WITH {READINGS} SELECT device_id, event_id, ms AS ts, 1::BIGINT AS count, value AS mean, 0.0::DOUBLE AS stddev FROM readings")
def chart_minute(spark, sf):
    return analytics.chart_windows(readings(spark, sf), 1, "value", keys=["device_id", "event_id"])


@query(f"WITH {READINGS} SELECT device_id, CAST(ceil((max(ms) - min(ms)) / 60000.0 / 30) AS BIGINT) AS windows, CAST(ceil((max(ms) - min(ms)) / 60000.0) AS BIGINT) AS minutes FROM readings GROUP BY 1")
def table_metadata(spark, sf):
    return analytics.table_metadata(readings(spark, sf), 30)


@query(f"""WITH {READINGS}, r AS (SELECT device_id, ms, row_number() OVER (PARTITION BY device_id ORDER BY ms) AS i FROM readings), f AS (SELECT * FROM r WHERE i <= 100),
d AS (SELECT device_id, ms - lag(ms) OVER (PARTITION BY device_id ORDER BY ms) AS d FROM f), n AS (SELECT device_id FROM f GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT device_id, d, row_number() OVER (PARTITION BY device_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS k FROM d JOIN n USING (device_id) WHERE d > 0)
SELECT device_id, d AS width FROM s WHERE i = k // 2""")
def input_bin_width(spark, sf):
    return analytics.input_bin_width(readings(spark, sf))


@query(f"WITH {BINS}, days AS (SELECT DISTINCT device_id, {fixed(DAY)} AS ts FROM readings) SELECT device_id, ts, mean FROM days LEFT JOIN b USING (device_id, ts)")
def grid_fill(spark, sf):
    days = readings(spark, sf).select("device_id", floor_bin(F.col("ms"), "1d").alias("ts")).distinct()
    return analytics.align(days, _bins(spark, sf), ["device_id", "ts"], ["mean"])


# Ingest ----------------------------------------------------------------------------------

HOUR_KEY = "date_trunc('hour', timestamp)"


def _hourly(spark, sf) -> DataFrame:
    return readings(spark, sf).select("device_id", F.date_trunc("hour", F.col("timestamp").cast("timestamp")).alias("hour"), "event_id", "value", "k")


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):
    query(f"WITH {READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id, {HOUR_KEY} ORDER BY event_id {_dir}) AS i FROM readings) SELECT device_id, epoch_ms({HOUR_KEY}) AS hour, event_id, value, k FROM r WHERE i = 1", f"dedupe_{_keep}")(
        lambda spark, sf, keep=_keep: ingest.dedupe(_hourly(spark, sf), ["device_id", "hour"], [F.col("event_id")], keep).withColumn("hour", epoch_ms("hour"))
    )


@query(f"""WITH {READINGS} SELECT device_id, epoch_ms({HOUR_KEY}) AS hour, count(DISTINCT (value, k)) AS variants,
 concat_ws(',', CASE WHEN count(DISTINCT value) > 1 THEN 'value' END, CASE WHEN count(DISTINCT k) + max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) > 1 THEN 'k' END) AS fields
 FROM readings GROUP BY 1, 2 HAVING count(DISTINCT (value, k)) > 1""")
def conflicts(spark, sf):
    return ingest.conflicts(_hourly(spark, sf), ["device_id", "hour"], ["value", "k"]).withColumn("hour", epoch_ms("hour"))


@query("SELECT user_id AS device_id, epoch_us(ts) // 1000 AS ms, value, event_type, event_id FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12')")
def delete_range(spark, sf):
    kept = ingest.delete_range(readings(spark, sf), "timestamp", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return kept.select("device_id", "ms", "value", "event_type", "event_id")


@query(f"""WITH {READINGS}, h AS (SELECT device_id, {HOUR_KEY} AS hour, event_id, value FROM readings), o AS (SELECT device_id, hour, arg_min(value, event_id) AS value FROM h WHERE event_id % 2 = 0 GROUP BY ALL),
n AS (SELECT device_id, hour, arg_min(value, event_id) AS value FROM h WHERE event_id % 2 = 1 GROUP BY ALL) SELECT device_id, epoch_ms(hour) AS hour, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (device_id, hour)""")
def merge_replace(spark, sf):
    h = _hourly(spark, sf)
    part = lambda odd: ingest.dedupe(h.where(F.col("event_id") % 2 == odd), ["device_id", "hour"], [F.col("event_id")]).select("device_id", "hour", "value")
    return ingest.merge(part(0), part(1), ["device_id", "hour"], ["value"], "replace").withColumn("hour", epoch_ms("hour"))


@query("SELECT n_name AS name, count(*) AS suppliers, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY 1 UNION ALL SELECT 'Device ' || s_nationkey, count(*), sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey >= 3 GROUP BY 1")
def device_names(spark, sf):
    """The table of names lacks two regions on purpose: their devices go by number."""
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("device_id"), "s_acctbal")
    names = load(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("device_id"), F.col("n_name").alias("name"))
    return analytics.device_names(s, names).groupBy("name").agg(F.count("*").alias("suppliers"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS records, epoch_ms(min(o_orderdate)) AS earliest, epoch_ms(max(o_orderdate)) AS latest FROM orders GROUP BY ALL")
def union_months(spark, sf):
    """The years one by one, put together again; each part with its range of dates."""
    o = load(spark, sf, "orders").withColumn("ms", epoch_ms("o_orderdate"))
    cuts = [epoch_of(y) for y in range(1995, 2002)]
    parts = [ingest.in_range(o, "o_orderdate", a, b) for a, b in zip([-(1 << 45), *cuts], [*cuts, 1 << 45])]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(period_label(F.col("ms"), "mo").alias("month"), "o_orderpriority").agg(F.count("*").alias("records"), F.min("ms").alias("earliest"), F.max("ms").alias("latest"))


@query("""SELECT event_id, CASE WHEN a < 120000 THEN 'fresh' WHEN a < 600000 THEN 'warn' WHEN a < 3600000 THEN 'degraded' ELSE 'stale' END AS age
 FROM (SELECT event_id, epoch_ms(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000 AS a FROM events)""")
def age_classes(spark, sf):
    return readings(spark, sf).select("event_id", codec.age_class(GENESIS + 31 * DAY - F.col("ms")).alias("age"))


@query("""SELECT event_id, CASE WHEN t = 0 THEN '0m' ELSE concat_ws(' ', CASE WHEN t >= 1440 THEN (t // 1440) || 'd' END, CASE WHEN t % 1440 >= 60 THEN (t % 1440 // 60) || 'h' END, CASE WHEN t % 60 > 0 THEN (t % 60) || 'm' END) END AS age
 FROM (SELECT event_id, (epoch_ms(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000) // 60000 AS t FROM events)""")
def human_ages(spark, sf):
    return readings(spark, sf).select("event_id", codec.human_duration(GENESIS + 31 * DAY - F.col("ms")).alias("age"))


# Devices (a missing mark or genesis is shown as such) ---------------------------------------------------------------------------------

DEVICE_ROWS = "d AS (SELECT s_suppkey AS device_id, s_name AS name, 'n' || s_nationkey AS device_type, NULL::BIGINT AS genesis, CASE WHEN s_suppkey % 7 = 0 THEN FALSE WHEN s_suppkey % 7 = 1 THEN NULL ELSE TRUE END AS active, 0::BIGINT AS refreshed_at FROM supplier)"


_SHOWN = "device_id, name, device_type, coalesce(genesis, -1) AS genesis, coalesce(active::VARCHAR, 'unset') AS active, refreshed_at"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("genesis", F.coalesce("genesis", F.lit(-1).cast("long"))).withColumn("active", F.coalesce(F.col("active").cast("string"), F.lit("unset")))


def _device_rows(spark, sf) -> DataFrame:
    mark = F.when(F.col("s_suppkey") % 7 == 0, False).when(F.col("s_suppkey") % 7 != 1, True)
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("device_id"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("device_type"), F.lit(None).cast("long").alias("genesis"), mark.alias("active"), F.lit(0).cast("long").alias("refreshed_at"))


@query(f"WITH {DEVICE_ROWS} SELECT {_SHOWN} FROM d WHERE active IS NOT FALSE")
def devices_active(spark, sf):
    return _shown(devices.active(_device_rows(spark, sf)))


@query(f"WITH {DEVICE_ROWS}, o AS (SELECT user_id AS device_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'own ' || user_id END AS name FROM events GROUP BY 1), x AS (SELECT d.* REPLACE (coalesce(o.name, d.name) AS name) FROM d LEFT JOIN o USING (device_id)) SELECT {_SHOWN} FROM x")
def devices_overridden(spark, sf):
    named = readings(spark, sf).select("device_id").distinct().withColumn("name", F.when(F.col("device_id") % 3 != 0, F.concat(F.lit("own "), F.col("device_id").cast("string"))))
    return _shown(devices.override(_device_rows(spark, sf), named))


@query(f"WITH {READINGS}, {DEVICE_ROWS}, b AS (SELECT device_id, name, device_type, min(ms) - min(ms) % 60000 AS genesis, active, {NOW}::BIGINT AS refreshed_at FROM d JOIN readings USING (device_id) WHERE active IS NOT FALSE GROUP BY ALL), x AS (SELECT * FROM b UNION ALL SELECT * FROM d ANTI JOIN b USING (device_id)) SELECT {_SHOWN} FROM x")
def devices_seeded(spark, sf):
    held = _device_rows(spark, sf)
    return _shown(devices.upsert(held, devices.bootstrap(held, readings(spark, sf), NOW)))


# Registry --------------------------------------------------------------------------------

DAY_SHARDS = f"{READINGS}, shards AS (SELECT device_id, 'raw' AS tier, '1d' AS rung, {fixed(DAY)} AS period_start, {fixed(DAY)} + {DAY} AS period_end, {fixed(DAY)} + {DAY} * (1 + device_id % 20) AS written_at, count(*) AS n_rows, count(DISTINCT event_type) AS n_rgs, sum(length(event_type))::BIGINT AS size_bytes FROM readings GROUP BY ALL)"
RECORDED = f"{DAY_SHARDS}, recorded AS (SELECT * FROM shards WHERE (period_start // {DAY} + device_id) % 5 <> 0)"
DEVICES = f"devices AS (SELECT device_id, min(ms) - min(ms) % 60000 AS genesis FROM readings GROUP BY 1)"
JOURNAL = f'journal AS (SELECT {GENESIS} + (s_suppkey % 30) * {DAY} + 7200000 AS "start", {GENESIS} + (s_suppkey % 30) * {DAY} + 136800000 AS "end", {GENESIS} + (s_suppkey % 30 + 12) * {DAY} AS requested_at FROM supplier WHERE s_suppkey % 3 = 0)'


def _shards(spark, sf) -> DataFrame:
    r = readings(spark, sf).withColumn("period_start", floor_bin(F.col("ms"), "1d"))
    s = r.groupBy("device_id", "period_start").agg(F.count("*").alias("n_rows"), F.count_distinct("event_type").alias("n_rgs"), F.sum(F.length("event_type")).alias("size_bytes"))
    end = F.col("period_start") + DAY
    return s.select("device_id", F.lit("raw").alias("tier"), F.lit("1d").alias("rung"), "period_start", end.alias("period_end"), (F.col("period_start") + DAY * (1 + F.col("device_id") % 20)).alias("written_at"), "n_rows", "n_rgs", "size_bytes")


def _recorded(spark, sf) -> DataFrame:
    return _shards(spark, sf).where((F.floor(F.col("period_start") / DAY) + F.col("device_id")) % 5 != 0)


def _journal(spark, sf) -> DataFrame:
    at = GENESIS + (F.col("s_suppkey") % 30) * DAY
    return load(spark, sf, "supplier").where("s_suppkey % 3 = 0").select((at + 7_200_000).alias("start"), (at + 136_800_000).alias("end"), (at + 12 * DAY).alias("requested_at"))


def _devices(spark, sf) -> DataFrame:
    return genesis(spark, sf)


def cover_sql(rungs: list[str], now: int) -> str:
    widths = [(r, Duration.of(r).ms) for r in reversed(rungs)]
    fits = lambda w: f"(pos - pos % {w} + {w} <= {now} AND (pos % {w} = 0 OR pos = genesis))"
    pick = "CASE " + " ".join(f"WHEN {fits(w)} THEN {w}" for _, w in widths) + " END"
    name = "CASE w " + " ".join(f"WHEN {w} THEN '{r}'" for r, w in widths) + " END"
    return f"""WITH RECURSIVE {READINGS}, {DEVICES}, c AS (
 SELECT device_id, genesis, genesis AS pos, NULL::BIGINT AS was, NULL::BIGINT AS w FROM devices
 UNION ALL SELECT device_id, genesis, pos - pos % p + p, pos, p FROM (SELECT *, {pick} AS p FROM c WHERE pos < {now}) WHERE p IS NOT NULL)
SELECT device_id, {name} AS rung, pos - w AS period_start, pos AS period_end, was AS effective_start FROM c WHERE w IS NOT NULL"""


@query(cover_sql(["4d", "32d", "128d"], NOW))
def expected_shards(spark, sf):
    out = registry.expected(_devices(spark, sf), {"m30": ["4d", "32d", "128d"]}, NOW)
    return out.select("device_id", "rung", "period_start", "period_end", "effective_start")


EXPECTED_DAYS = f"expected AS (SELECT device_id, unnest(range(genesis - genesis % {DAY}, {GENESIS + 31 * DAY}, {DAY})) AS period_start FROM devices)"


def _expected_days(spark, sf) -> DataFrame:
    return registry.expected(_devices(spark, sf), {"raw": ["1d"]}, GENESIS + 31 * DAY)


@query(f"WITH {RECORDED}, {DEVICES}, {EXPECTED_DAYS} SELECT device_id, period_start FROM expected ANTI JOIN recorded USING (device_id, period_start)")
def missing_shards(spark, sf):
    return registry.missing(_expected_days(spark, sf), _recorded(spark, sf)).select("device_id", "period_start")


@query(f'WITH {RECORDED}, {JOURNAL} SELECT device_id, period_start, written_at FROM recorded r WHERE EXISTS (SELECT 1 FROM journal j WHERE r.period_start < j."end" AND r.period_end > j."start" AND r.written_at < j.requested_at)')
def stale_shards(spark, sf):
    return registry.stale(_recorded(spark, sf), _journal(spark, sf)).select("device_id", "period_start", "written_at")


@query(f'WITH {RECORDED}, {JOURNAL} SELECT DISTINCT "start", "end", requested_at FROM journal j WHERE EXISTS (SELECT 1 FROM recorded r WHERE r.period_start < j."end" AND r.period_end > j."start" AND r.written_at < j.requested_at)')
def journal_pruned(spark, sf):
    return registry.prune_journal(_journal(spark, sf), _recorded(spark, sf)).distinct()


_SLOTS = f"""slots AS (SELECT device_id, 0 AS place, 'raw' AS tier, '1d' AS rung, period_start, period_start + {DAY} AS period_end FROM expected
 UNION ALL SELECT device_id, 2, 'm10', '1d', period_start, period_start + {DAY} FROM expected)"""


@query(f"""WITH {RECORDED}, {DEVICES}, {EXPECTED_DAYS}, {JOURNAL}, {_SLOTS}, held AS (SELECT device_id, tier, rung, period_start, period_end, written_at FROM recorded UNION ALL SELECT device_id, 'm10', rung, period_start, period_end, written_at + {5 * DAY} FROM recorded WHERE device_id % 2 = 0),
 s AS (SELECT device_id, tier, rung, period_start FROM held r WHERE EXISTS (SELECT 1 FROM journal j WHERE r.period_start < j."end" AND r.period_end > j."start" AND r.written_at < j.requested_at)),
 todo AS (SELECT * FROM slots ANTI JOIN held USING (device_id, tier, rung, period_start) UNION SELECT * FROM slots SEMI JOIN s USING (device_id, tier, rung, period_start))
 SELECT row_number() OVER (ORDER BY place, period_end - period_start, period_start, device_id) AS place, device_id, tier, rung, period_start FROM todo""")
def work_list(spark, sf):
    """Missing and stale slots of two tiers, numbered in the order to build them."""
    wanted = registry.expected(_devices(spark, sf), {"m10": ["1d"], "raw": ["1d"]}, GENESIS + 31 * DAY)
    raw = _recorded(spark, sf).drop("n_rows", "n_rgs", "size_bytes")
    held = raw.unionByName(raw.where("device_id % 2 = 0").withColumn("tier", F.lit("m10")).withColumn("written_at", F.col("written_at") + 5 * DAY))
    return _numbered(registry.work(wanted, held, _journal(spark, sf), ["raw", "m10"]))


def _numbered(rows: DataFrame) -> DataFrame:
    """The place of each row of an ordered result: its place in its part, and the rows of the parts before, of which there is one number each."""
    spark, path = rows.sparkSession, _scratch(rows.sparkSession, "ordered")
    rows.select("device_id", "tier", "rung", "period_start").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)  # a part's number is in the id's upper bits
    held = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = held.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return held.join(before, "_part").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select("device_id", "tier", "rung", "period_start", "place")


_LONG = "SELECT device_id, rung, period_start, period_start + w AS period_end, period_start + (device_id % 40) * 86400000 AS written_at FROM (SELECT DISTINCT device_id, rung, w, ms - ms % w AS period_start FROM readings, (VALUES ('128d', 128 * 86400000::BIGINT), ('512d', 512 * 86400000::BIGINT)) v(rung, w))"


@query(f'WITH {READINGS}, {JOURNAL}, recorded AS ({_LONG}) SELECT * FROM recorded r WHERE EXISTS (SELECT 1 FROM journal j WHERE r.period_start < j."end" AND r.period_end > j."start" AND r.written_at + 15000000000 < j.requested_at)')
def stale_long_rungs(spark, sf):
    """Shards of 128 and 512 days that late entries of the journal reach."""
    at = readings(spark, sf).select("device_id", "ms")
    rungs = [at.select("device_id", F.lit(r).alias("rung"), floor_bin(F.col("ms"), r).alias("period_start")).distinct().withColumn("period_end", F.col("period_start") + Duration.of(r).ms) for r in ("128d", "512d")]
    held = reduce(DataFrame.unionByName, rungs).withColumn("written_at", F.col("period_start") + (F.col("device_id") % 40) * DAY).withColumn("tier", F.lit("d1"))
    shifted = _journal(spark, sf).withColumn("requested_at", F.col("requested_at") - 15_000_000_000)
    return registry.stale(held, shifted).drop("tier")


@query(f"WITH {RECORDED}, {DEVICES}, {EXPECTED_DAYS} SELECT device_id, 'm10' AS tier, period_start FROM expected UNION ALL SELECT device_id, 'raw', period_start FROM expected WHERE FALSE")
def work_without_tip(spark, sf):
    """Nothing is built yet and the raw day shards are the tip's own: the rest is to build."""
    wanted = registry.expected(_devices(spark, sf), {"m10": ["1d"], "raw": ["1d"]}, GENESIS + 31 * DAY)
    nothing, journal = _recorded(spark, sf).limit(0), _journal(spark, sf)
    return registry.work(wanted, nothing, journal, ["raw", "m10"], tip=("raw", "1d")).select("device_id", "tier", "period_start")


@query(f"""WITH {RECORDED}, n AS (SELECT device_id, tier, rung, period_start, period_end, written_at + 1000 AS written_at, n_rows + 1 AS n_rows FROM shards WHERE device_id % 3 = 0)
 SELECT device_id, tier, rung, period_start, coalesce(n.period_end, r.period_end) AS period_end, coalesce(n.written_at, r.written_at) AS written_at, coalesce(n.n_rows, r.n_rows) AS n_rows, coalesce(r.size_bytes, -1) AS size_bytes FROM recorded r FULL JOIN n USING (device_id, tier, rung, period_start)""")
def registry_upsert(spark, sf):
    held = _recorded(spark, sf).drop("n_rgs")
    new = _shards(spark, sf).where("device_id % 3 = 0").select("device_id", "tier", "rung", "period_start", "period_end", (F.col("written_at") + 1000).alias("written_at"), (F.col("n_rows") + 1).alias("n_rows"))
    return registry.upsert(held, new).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(-1).cast("long")))


@query(f"WITH {RECORDED}, w AS (SELECT device_id, tier, rung, max(period_end) AS e, arg_max(written_at, (period_end, written_at)) AS u FROM recorded GROUP BY ALL) SELECT device_id, tier, rung, greatest(e, {GENESIS + 20 * DAY}) AS latest_period_end, greatest(u, {GENESIS + 40 * DAY}) AS updated_at FROM w")
def watermarks_upserted(spark, sf):
    held = registry.watermarks(_recorded(spark, sf))
    new = held.withColumn("latest_period_end", F.lit(GENESIS + 20 * DAY)).withColumn("updated_at", F.lit(GENESIS + 40 * DAY))
    return registry.upsert_watermarks(held, new)


@query(f"WITH {RECORDED}, {DEVICES} SELECT device_id, period_start FROM recorded r WHERE EXISTS (SELECT 1 FROM (SELECT unnest([{GENESIS + 2 * DAY + 5}, {GENESIS + 9 * DAY}]) AS s, unnest([{GENESIS + 4 * DAY}, {GENESIS + 9 * DAY + 1}]) AS e) t WHERE r.period_start < e AND r.period_end > s)")
def shards_overlapping(spark, sf):
    targets = spark.createDataFrame([(GENESIS + 2 * DAY + 5, GENESIS + 4 * DAY), (GENESIS + 9 * DAY, GENESIS + 9 * DAY + 1)], "effective_start long, effective_end long")
    return registry.shards_overlapping(_recorded(spark, sf), targets).select("device_id", "period_start")


@query(f"WITH {RECORDED} SELECT device_id, tier, rung, max(period_end) AS latest_period_end, arg_max(written_at, period_end) AS updated_at FROM recorded GROUP BY 1, 2, 3")
def watermarks(spark, sf):
    return registry.watermarks(_recorded(spark, sf))


@query(f"WITH {RECORDED} SELECT device_id, tier, rung, count(*) AS shards, max(written_at) AS last_written, avg(size_bytes) AS mean_bytes, avg(n_rows) AS mean_rows, avg(n_rgs) AS mean_rgs, round(avg(CASE WHEN n_rgs > 0 THEN n_rows / n_rgs END), 9) AS mean_rows_a_rg FROM recorded GROUP BY 1, 2, 3")
def rung_stats(spark, sf):
    return registry.rung_stats(_recorded(spark, sf)).withColumn("mean_rows_a_rg", F.round("mean_rows_a_rg", 9))


COVER = f"{RECORDED}, {DEVICES}, {EXPECTED_DAYS}, slots AS (SELECT e.device_id, e.period_start, CASE WHEN r.device_id IS NOT NULL THEN 'present' WHEN s.device_id IS NOT NULL THEN 'pending' ELSE 'missing' END AS status FROM expected e LEFT JOIN recorded r USING (device_id, period_start) LEFT JOIN shards s USING (device_id, period_start)), cover AS (SELECT device_id, 'raw' AS tier, count(*) AS expected, count(*) FILTER (WHERE status = 'present') AS present, count(*) FILTER (WHERE status = 'pending') AS pending, min(CASE WHEN status = 'missing' THEN period_start END) AS first_missing, count(*) FILTER (WHERE status = 'missing') = 0 AS complete FROM slots GROUP BY 1)"


@query(f"WITH {COVER} SELECT * FROM cover")
def coverage(spark, sf):
    return registry.coverage(registry.slots(_expected_days(spark, sf), _recorded(spark, sf), _shards(spark, sf)))


@query(f"""WITH {RECORDED}, {DEVICES}, {EXPECTED_DAYS}, wide AS ({cover_sql(["4d", "32d"], NOW)}), all_ AS (SELECT device_id, 'raw' AS tier, '1d' AS rung, period_start FROM expected UNION ALL SELECT device_id, 'm30', rung, period_start FROM wide),
 held AS (SELECT device_id, 'raw' AS tier, '1d' AS rung, period_start FROM recorded UNION ALL SELECT device_id, 'm30', rung, period_start FROM wide WHERE device_id % 2 = 0 OR rung = '32d' AND device_id % 5 = 0),
 slots AS (SELECT a.*, CASE WHEN h.device_id IS NOT NULL THEN 'present' WHEN s.device_id IS NOT NULL THEN 'pending' ELSE 'missing' END AS status FROM all_ a LEFT JOIN held h ON h.device_id = a.device_id AND h.tier = a.tier AND h.rung = a.rung AND h.period_start = a.period_start LEFT JOIN shards s ON a.tier = 'raw' AND s.device_id = a.device_id AND s.period_start = a.period_start)
 SELECT CASE grouping_id(device_id, tier, rung) WHEN 0 THEN 'rung' WHEN 1 THEN 'tier' ELSE 'device' END AS level, device_id, coalesce(tier, '') AS tier, coalesce(rung, '') AS rung, count(*) AS expected, count(*) FILTER (WHERE status = 'present') AS present, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'missing') AS missing, coalesce(min(CASE WHEN status = 'missing' THEN period_start END), -1) AS first_missing, count(*) FILTER (WHERE status = 'missing') = 0 AS complete
 FROM slots GROUP BY GROUPING SETS ((device_id, tier, rung), (device_id, tier), (device_id))""")
def coverage_levels(spark, sf):
    """Coverage of two tiers by rung, tier and device."""
    wide = registry.expected(_devices(spark, sf), {"m30": ["4d", "32d"]}, NOW)
    some = wide.where("device_id % 2 = 0 or (rung = '32d' and device_id % 5 = 0)").select(*registry.KEY)
    held = _recorded(spark, sf).select(*registry.KEY).unionByName(some)
    out = registry.coverage_levels(registry.slots(_expected_days(spark, sf).unionByName(wide), held, _shards(spark, sf)))
    return out.withColumns({"tier": F.coalesce("tier", F.lit("")), "rung": F.coalesce("rung", F.lit("")), "first_missing": F.coalesce("first_missing", F.lit(-1).cast("long"))})


_STALE = 's AS (SELECT device_id, count(*) AS stale FROM recorded r WHERE EXISTS (SELECT 1 FROM journal j WHERE r.period_start < j."end" AND r.period_end > j."start" AND r.written_at < j.requested_at) GROUP BY 1)'


@query(f"""WITH {COVER}, {JOURNAL}, {_STALE}, g AS (SELECT device_id, count(*) AS shards, max(written_at) AS last_written FROM recorded GROUP BY 1), u AS (SELECT device_id, max(ms) AS uploaded FROM readings GROUP BY 1)
 SELECT c.device_id, expected, present, pending, coalesce(stale, 0) AS stale, {DAY // 2_000}::BIGINT AS dust_age_s, shards, last_written, uploaded,
 CASE WHEN expected - present - pending > 0 THEN (expected - present - pending) || ' missing' WHEN pending > 0 THEN pending || ' pending' ELSE 'complete' END AS badge
 FROM cover c LEFT JOIN s USING (device_id) LEFT JOIN g USING (device_id) LEFT JOIN u USING (device_id)""")
def health(spark, sf):
    """Coverage with stale counts and dust, the rung's statistics and the newest reading, a device."""
    recorded = _recorded(spark, sf)
    cover = registry.coverage(registry.slots(_expected_days(spark, sf), recorded, _shards(spark, sf)), registry.stale(recorded, _journal(spark, sf)), GENESIS + 31 * DAY + DAY // 2)
    tips = readings(spark, sf).select("device_id", F.col("ms").alias("uploaded"))
    out = analytics.health(cover, registry.rung_stats(recorded), tips)
    return out.select("device_id", "expected", "present", "pending", "stale", "dust_age_s", F.col("rungs")[0]["shards"].alias("shards"), F.col("rungs")[0]["last_written"].alias("last_written"), "uploaded", "badge")


@query(f"WITH {COVER} SELECT device_id, CAST(expected - present - pending AS BIGINT) AS missing, pending, complete AS all_complete FROM cover")
def device_coverage(spark, sf):
    return registry.device_coverage(coverage(spark, sf))


@query(f"""WITH {RECORDED}, {DEVICES} SELECT device_id, rung, period_start, period_end FROM recorded WHERE period_end <= {GENESIS + 25 * DAY} UNION ALL
 SELECT device_id, '1d', d, d + {DAY} FROM (SELECT device_id, unnest(range(genesis - genesis % {DAY}, {GENESIS + 31 * DAY}, {DAY})) AS d FROM devices) x WHERE NOT EXISTS (SELECT 1 FROM recorded r WHERE r.device_id = x.device_id AND r.period_end <= {GENESIS + 25 * DAY} AND r.period_start <= d AND r.period_end >= d + {DAY})""")
def raw_tip_days(spark, sf):
    spans = _devices(spark, sf).select("device_id", F.col("genesis").alias("start"), F.lit(GENESIS + 31 * DAY).alias("end"))
    return registry.raw_tips(_recorded(spark, sf), spans, GENESIS + 25 * DAY)


@query(f"WITH {READINGS}, d AS (SELECT DISTINCT device_id FROM readings) SELECT device_id, CAST(((row_number() OVER (ORDER BY device_id) - 1 - 17) % n + n) % n AS BIGINT) AS turn FROM d, (SELECT count(*) AS n FROM d)")
def rotation(spark, sf):
    return analytics.rotation(readings(spark, sf).select("device_id").distinct(), 17)


@query("""WITH c AS (SELECT event_type || (user_id % 10) AS key, event_id AS seq, CAST(floor(value) AS BIGINT) AS bytes, user_id % 7 AS ms, user_id % 3 = 0 AS cached FROM events), f AS (SELECT key, min(seq) AS first FROM c GROUP BY 1)
SELECT key, count(*) AS calls, sum(bytes)::BIGINT AS bytes, sum(ms)::BIGINT AS ms, sum(CASE WHEN seq = first THEN bytes ELSE 0 END)::BIGINT AS meta_bytes, sum(CASE WHEN seq = first THEN 0 ELSE bytes END)::BIGINT AS data_bytes, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE cached) / count(*) AS hit_share FROM c JOIN f USING (key) GROUP BY 1""")
def fetch_trace(spark, sf):
    return analytics.fetch_trace(_calls(spark, sf))


@query("""WITH c AS (SELECT event_type || (user_id % 10) AS key, event_id AS seq, CAST(floor(value) AS BIGINT) AS bytes, user_id % 7 AS ms, user_id % 3 = 0 AS cached FROM events), f AS (SELECT key, min(seq) AS first FROM c GROUP BY 1)
SELECT count(*) AS calls, sum(bytes)::BIGINT AS bytes, sum(ms)::BIGINT AS ms, sum(CASE WHEN seq = first THEN bytes ELSE 0 END)::BIGINT AS meta_bytes, sum(CASE WHEN seq = first THEN 0 ELSE bytes END)::BIGINT AS data_bytes, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE cached) / count(*) AS hit_share FROM c JOIN f USING (key)""")
def fetch_totals(spark, sf):
    return analytics.fetch_trace(_calls(spark, sf), by_key=False)


def _calls(spark, sf) -> DataFrame:
    e = load(spark, sf, "events")
    calls = e.select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("bytes"), (F.col("user_id") % 7).alias("ms"), (F.col("user_id") % 3 == 0).alias("cached"))
    return calls


@query(f"WITH {READINGS} SELECT device_id, strftime(timestamp, '%Y-%m') AS label, count(*) AS records, epoch_ms(date_trunc('month', min(timestamp)) + INTERVAL 1 MONTH) AS period_end FROM readings GROUP BY 1, 2")
def period_labels(spark, sf):
    r = readings(spark, sf).withColumn("p", floor_bin(F.col("ms"), "1mo"))
    return r.groupBy("device_id", "p").agg(F.count("*").alias("records")).select("device_id", period_label(F.col("p"), "mo").alias("label"), "records", bin_end(F.col("p"), "1mo").alias("period_end"))


@query(f"WITH {RECORDED}, c AS (SELECT device_id, period_start - period_start % {4 * DAY} AS s, count(*) AS n FROM recorded GROUP BY 1, 2) SELECT device_id, s AS period_start, s + {4 * DAY} AS period_end, n AS inputs_present, 4::BIGINT AS inputs_expected FROM c WHERE s + {4 * DAY} <= {GENESIS + 31 * DAY}")
def consolidation(spark, sf):
    out = registry.consolidation(_recorded(spark, sf), "raw", "1d", "4d", GENESIS + 31 * DAY)
    return out.select("device_id", "period_start", "period_end", "inputs_present", "inputs_expected")


@query(f"WITH {RECORDED}, c AS (SELECT device_id, period_start - period_start % {4 * DAY} AS s, count(*) AS n FROM recorded GROUP BY 1, 2) SELECT device_id, s AS period_start FROM c WHERE n = 4 AND s + {4 * DAY} <= {GENESIS + 31 * DAY}")
def consolidated(spark, sf):
    return registry.record_complete(consolidation(spark, sf)).select("device_id", "period_start")


@query(f"WITH {READINGS} {tier_sql(DAY)}")
def backfill_d1(spark, sf):
    """Every tier written under a fresh path, the daily one read back."""
    from .plans import build

    path = _scratch(spark, "pyramid")
    build.backfill(PYRAMID, readings(spark, sf), path)
    return build.tier(PYRAMID, spark, path, "d1")


@query(f"WITH {READINGS} {tier_sql(7_200_000)}")
def rebuild_late(spark, sf):
    """A backfill that lacks three days' late readings, then a rebuild of the days they touch."""
    from .plans import build

    path, all_ = _scratch(spark, "pyramid"), readings(spark, sf)
    late = ingest.half_open(F.col("ms"), START + 3_600_000, START + 2 * DAY + 5)
    build.backfill(PYRAMID, all_.where(~late), path)
    build.rebuild(PYRAMID, all_, path, [(START + 3_600_000, START + DAY), (START + DAY, START + 2 * DAY + 5)])
    return build.tier(PYRAMID, spark, path, "h2")


WEEK = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], "tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["7d"]}, {"name": "week", "bin": "7d", "shards": ["28d"]}]})


@query(f"WITH {READINGS} {tier_sql(7 * DAY)}")
def rebuild_week(spark, sf):
    """Late readings of one day: the rebuilt weeks hold the other days' readings too."""
    from .plans import build

    path, all_ = _scratch(spark, "weeks"), readings(spark, sf)
    late = ingest.half_open(F.col("ms"), START + DAY, START + 2 * DAY)
    build.backfill(WEEK, all_.where(~late), path)
    build.rebuild(WEEK, all_, path, [(START + DAY, START + 2 * DAY)])
    return build.tier(WEEK, spark, path, "week")


@query(f"WITH {READINGS} {tier_sql(DAY, f'NOT (ms >= {START + DAY} AND ms < {START + 3 * DAY})')}")
def rebuild_deleted(spark, sf):
    """Two days lose all their readings: their bins go with the rebuild."""
    from .plans import build

    path, all_ = _scratch(spark, "deleted"), readings(spark, sf)
    build.backfill(WEEK, all_, path)
    gone = ingest.half_open(F.col("ms"), START + DAY, START + 3 * DAY)
    build.rebuild(WEEK, all_.where(~gone), path, [(START + DAY, START + 3 * DAY)])
    return build.tier(WEEK, spark, path, "d1")


@query(f"WITH {RECORDED}, c AS (SELECT device_id, period_start - period_start % {4 * DAY} AS s, count(*) AS n FROM recorded GROUP BY 1, 2), w AS (SELECT device_id, s FROM c WHERE n = 4 AND s + {4 * DAY} <= {GENESIS + 31 * DAY}), t AS ({tier_sql(60_000)}) SELECT t.*, w.s AS period_start FROM t JOIN w ON t.device_id = w.device_id AND ts - ts % {4 * DAY} = w.s")
def consolidate_write(spark, sf):
    """Day shards written, then the four-day shards that recorded ones tile, read back."""
    from .plans import build

    path = _scratch(spark, "shards")
    tier = rollup.aggregate_raw(readings(spark, sf), "1min", [VALUE])
    build.write_shards(tier, path, "raw", "1d")
    build.consolidate(PYRAMID, path, _recorded(spark, sf), "raw", "1d", "4d", GENESIS + 31 * DAY)
    return build.read_shards(spark, PYRAMID, path, "raw", "4d")


@query(f"WITH {READINGS} {tier_sql(DAY)}")
def converged_d1(spark, sf):
    """A pyramid built from nothing by the work its registry lacks."""
    from .plans import build

    path, rows = _scratch(spark, "converge"), readings(spark, sf)
    first = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], "tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["1d", "4d"]}]})
    nothing = _recorded(spark, sf).limit(0).select("device_id", "tier", "rung", "period_start", "period_end", "written_at")
    results = build.converge(first, _devices(spark, sf), nothing, _journal(spark, sf).limit(0), rows, path, GENESIS + 32 * DAY, budget_s=3_600.0).results
    if any(status != "written" for _, status, _ in results):
        raise RuntimeError(f"not converged: {results}")
    return build.tier(first, spark, path, "d1")


TWO_TIERS = {"tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["1d", "4d"]}]}
_HOLE = f"device_id % 7 = 3 AND ms >= {GENESIS + 10 * DAY} AND ms < {GENESIS + 11 * DAY}"
#: Slots of both tiers and how many days with readings they have, of how many.
_INPUTS = f"""slots AS (SELECT 'd1' AS tier, * FROM ({cover_sql(["1d", "4d"], GENESIS + 32 * DAY)}) UNION ALL SELECT 'h6', * FROM ({cover_sql(["1d"], GENESIS + 32 * DAY)})),
 {READINGS}, held AS (SELECT DISTINCT device_id, ms - ms % {DAY} AS day FROM readings WHERE NOT ({_HOLE})),
 counted AS (SELECT s.device_id, tier, rung, period_start, period_end, (period_end - (effective_start - effective_start % {DAY})) // {DAY} AS wanted, count(day) AS found
  FROM slots s LEFT JOIN held h ON h.device_id = s.device_id AND day >= effective_start - effective_start % {DAY} AND day < period_end GROUP BY ALL)"""


def _with_hole(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Readings of which some devices lack a day, and devices of which one has no readings."""
    rows = readings(spark, sf).where(f"NOT ({_HOLE})")
    silent = _devices(spark, sf).select((F.lit(1_000_000) + F.col("device_id")).alias("device_id"), "genesis").where("device_id = 1000001")
    return rows, _devices(spark, sf).select("device_id", "genesis").unionByName(silent)


def _nothing(spark, sf) -> tuple[DataFrame, DataFrame]:
    return _recorded(spark, sf).limit(0).select("device_id", "tier", "rung", "period_start", "period_end", "written_at"), _journal(spark, sf).limit(0)


@query(f"WITH {_INPUTS} SELECT device_id, tier, rung, period_start, period_end, {GENESIS + 32 * DAY} AS written_at FROM counted WHERE found = wanted")
def converge_registry(spark, sf):
    """The registry after a run over a device without readings and devices with a hole: only shards whose inputs were all there."""
    from .plans import build

    p = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], **TWO_TIERS})
    rows, fleet = _with_hole(spark, sf)
    return build.converge(p, fleet, *_nothing(spark, sf), rows, _scratch(spark, "converge"), GENESIS + 32 * DAY, budget_s=3_600.0).registry


@query(f"""WITH {_INPUTS}, broken AS (SELECT 1 AS run, device_id, tier, rung, period_start, CASE WHEN tier = 'd1' THEN 'held' WHEN found = 0 THEN 'no_inputs' ELSE 'failed' END AS status FROM counted WHERE device_id = 5)
 SELECT * FROM broken UNION ALL SELECT 2, device_id, tier, rung, period_start, CASE WHEN found = 0 THEN 'no_inputs' WHEN found < wanted THEN 'partial' ELSE 'written' END FROM counted WHERE device_id = 5
 UNION ALL SELECT 3, device_id, tier, rung, period_start, 'recorded' FROM counted WHERE found = wanted""")
def converge_after_failure(spark, sf):
    """A device's readings break the fine tier: its slots fail, its coarser ones are held; the next run heals them; the registry after both."""
    from .plans import build

    rows, fleet = _with_hole(spark, sf)
    nothing, journal = _nothing(spark, sf)
    path, now = _scratch(spark, "converge"), GENESIS + 32 * DAY
    of = lambda value: Pyramid.of({"metrics": [{"name": "value", "value": value, "scale": 2}], **TWO_TIERS})
    fleet = fleet.where("device_id < 1000000")
    first = build.converge(of("if(device_id = 5, raise_error('broken'), value)"), fleet, nothing, journal, rows, path, now, budget_s=3_600.0)
    second = build.converge(of("value"), fleet, first.registry, journal, rows, path, now, budget_s=3_600.0)
    told = lambda run, df: df.where("device_id = 5").select(F.lit(run).alias("run"), "device_id", "tier", "rung", "period_start", "status")
    recorded = second.registry.select(F.lit(3).alias("run"), "device_id", "tier", "rung", "period_start", F.lit("recorded").alias("status"))
    return told(1, first.slots).unionByName(told(2, second.slots)).unionByName(recorded)


@query(f"WITH {READINGS}, t AS ({tier_sql(60_000)}) SELECT t.*, ts - ts % {DAY} AS period_start FROM t")
def shards_by_device(spark, sf):
    """Day shards of odd devices, then those of even ones on the same days, then some of both again: all are there, once."""
    from .plans import build

    path = _scratch(spark, "shards")
    tier = rollup.aggregate_raw(readings(spark, sf), "1min", [VALUE])
    for some in ("device_id % 2 = 1", "device_id % 2 = 0", f"device_id % 5 = 0 AND ts < {GENESIS + 9 * DAY}"):
        build.write_shards(tier.where(some), path, "raw", "1d")
    return build.read_shards(spark, PYRAMID, path, "raw", "1d")


@query(f"""WITH {_INPUTS} SELECT device_id, tier, rung, period_start, CASE WHEN found = 0 THEN 'no_inputs' WHEN found < wanted THEN 'partial' ELSE 'written' END AS status FROM counted
 WHERE device_id % 2 = 1 OR found < wanted""")
def backfill_missing(spark, sf):
    """A backfill over a registry that has all that even devices' readings allow: what became of each slot it took up."""
    from .plans import build

    p = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], **TWO_TIERS})
    rows, fleet = _with_hole(spark, sf)
    fleet, path = fleet.where("device_id < 1000000"), _scratch(spark, "backfill")
    nothing, now = _nothing(spark, sf)[0], GENESIS + 32 * DAY
    even = build.backfill_missing(p, fleet.where("device_id % 2 = 0"), nothing, rows, path, now)
    return build.backfill_missing(p, fleet, even.registry, rows, path, now).slots.select("device_id", "tier", "rung", "period_start", "status")


@query(f"WITH {READINGS} {tier_sql(6 * 3_600_000, f'ms >= {GENESIS + 6 * DAY} AND ms < {GENESIS + 7 * DAY}')}")
def built_shard(spark, sf):
    """One shard of the fine tier, built by its label."""
    from .plans import build

    path = _scratch(spark, "shard")
    p = Pyramid.of({"metrics": [{"name": "value", "scale": 2}], **TWO_TIERS})
    if build.build_shard(p, readings(spark, sf), path, "h6", "1d", "2024-01-07") != build.Built("written", 1, 1):
        raise RuntimeError("the shard has no inputs")
    return build.tier(p, spark, path, "h6", GENESIS + 6 * DAY, GENESIS + 7 * DAY)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total, min(epoch_ms(o_orderdate)) AS first FROM orders WHERE o_custkey % 20 = 3 GROUP BY 1")
def month_files(spark, sf):
    """A device's readings as a file a month, read back as one table."""
    from .sources import files

    path, own = _scratch(spark, "months"), _priced(spark, sf).where("device_id = 3").select("timestamp", "o_totalprice")
    names = files.write_month_files(own, path)
    back = files.read_device(spark, path, own.schema)
    out = back.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.min(epoch_ms("timestamp")).alias("first"))
    return out.where(F.concat("month", F.lit(".parquet")).isin(names))


@query("SELECT user_id % 5 AS k, count(*) AS n_rows, TRUE AS whole FROM events GROUP BY 1")
def footer_rows(spark, sf):
    """Files' rows by their footers, and whether their row groups add up to them."""
    from .sources import files

    path = _scratch(spark, "footers")
    load(spark, sf, "events").withColumn("k", F.col("user_id") % 5).write.partitionBy("k").parquet(path)
    stats = files.footers(spark, path).withColumn("k", F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long"))
    adds = (F.aggregate("rg_row_counts", F.lit(0).cast("long"), lambda n, x: n + x) == F.col("n_rows")) & (F.size("rg_row_counts") == F.col("n_rgs"))
    return stats.groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.bool_and(adds).alias("whole"))


@query("SELECT event_id, epoch_ms(date_trunc(CASE event_id % 5 WHEN 0 THEN 'second' WHEN 1 THEN 'day' WHEN 2 THEN 'hour' WHEN 3 THEN 'minute' ELSE 'second' END, ts)::TIMESTAMP) AS ms FROM events")
def flexible_dates(spark, sf):
    """Times written in five of the forms that are read, and read."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyMMdd", "yyyyMMdd'T'HH", "yyMMdd'T'HHmm", "yyyyMMdd'T'HH:mm:ss"]
    text = reduce(lambda c, f: c.when(F.col("event_id") % 5 == f[0], F.date_format("ts", f[1])), list(enumerate(forms))[1:], F.when(F.col("event_id") % 5 == 0, F.date_format("ts", forms[0])))
    return load(spark, sf, "events").select("event_id", epoch_ms(codec.flexible_timestamp(text)).alias("ms"))


@query(f"WITH {RECORDED}, w AS (SELECT tier, device_id, max(period_end) AS e FROM recorded GROUP BY ALL) SELECT tier, min(e) AS fresh, (SELECT min(e) FROM w WHERE device_id < 5) AS fresh_of_some FROM w GROUP BY 1")
def fresh_until(spark, sf):
    """Up to where every device's shards reach, of all devices and of some."""
    held = _recorded(spark, sf)
    every, some = range_query.freshness(held), range_query.freshness(held, list(range(5)))
    return spark.createDataFrame([(t, e, some[t]) for t, e in every.items()], "tier string, fresh long, fresh_of_some long")


# Streams (final state; compared in tests with the batch result) ----------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    return s.select(F.col("user_id").alias("device_id"), F.col("ts").alias("timestamp"), "value", "event_id")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; without one set, a local session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {READINGS} {tier_sql(21_600_000)}")
def stream_tiers(spark, sf):
    from .streaming import ingest as stream

    path = _scratch(spark, "stream-tiers")
    q = stream.run(_stream(spark, sf), path, f"{path}/_checkpoint", "6h", [VALUE], key=["device_id", "event_id"], trigger={"availableNow": True})
    q.awaitTermination()
    return stream.current_bins(spark, path, [VALUE])


@query(f"WITH {READINGS} {tier_sql(21_600_000)}")
def stream_conflicts(spark, sf):
    """Every event comes a second time in a later batch with another value: the stored one stays, also when the batch is sent again after a compaction."""
    from .streaming import ingest as stream

    path, own = _scratch(spark, "stream-conflicts"), readings(spark, sf).select("device_id", "timestamp", "value", "event_id")
    send = lambda rows, i: stream.merge_batch(rows, i, path, "6h", [VALUE], "timestamp", ["device_id", "event_id"], "timestamp")
    changed = own.withColumn("value", F.col("value") + 1)
    send(own, 0)
    send(changed, 1)
    stream.compact(spark, path, (GENESIS // DAY, GENESIS // DAY + 15), ["device_id", "event_id"])
    send(changed, 1)
    send(changed.where("event_id % 3 = 0"), 2)
    return stream.current_bins(spark, path, [VALUE])


_LEFT = f"(SELECT device_id, ms, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM readings WHERE event_id % 11 <> 0)"


@query(f"WITH {READINGS} SELECT device_id, {fixed(21_600_000)} AS ts, {STATE} FROM {_LEFT} GROUP BY 1, 2")
def stream_deltas(spark, sf):
    """Readings, then replacements of some and deletions of others: bins by differences alone, folded half-way."""
    from .streaming import deltas

    path, own = _scratch(spark, "stream-deltas"), readings(spark, sf).select("device_id", "timestamp", "value", "event_id")
    stages = [own.withColumn("seq", F.lit(0)).withColumn("gone", F.lit(False)), own.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(1)).withColumn("gone", F.lit(False)), own.where("event_id % 11 = 0").withColumn("seq", F.lit(2)).withColumn("gone", F.lit(True))]
    for i, rows in enumerate(stages):
        rows.write.mode("append").parquet(f"{path}/in")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        deltas.run(arrived, path, f"{path}/_checkpoint", "6h", [VALUE], ["event_id"], order="seq", deleted="gone", trigger={"availableNow": True}).awaitTermination()
        if i == 1:
            deltas.fold(spark, path, [VALUE], i)
    return deltas.current_bins(spark, path, [VALUE])


_NEXT = "CASE WHEN level < 5 THEN 5 WHEN level < 15 THEN 15 WHEN level < 60 THEN 60 WHEN level >= 10080 THEN level + 1440 WHEN level >= 1440 THEN level + 360 WHEN level >= 360 THEN level + 120 ELSE level + 60 END"
_ALERTS = f"""{GAPS}, c AS (SELECT device_id, ms - 1 AS checked_at, ms - 1 - coalesce(ms - CAST(gap_seconds * 1000 AS BIGINT), epoch_ms(date_trunc('month', epoch_ms(ms - 1))::TIMESTAMP)) AS age, gap_seconds IS NOT NULL AS known,
  row_number() OVER (PARTITION BY device_id ORDER BY ms) AS i FROM g), m AS (SELECT device_id, checked_at, age // 60000 AS minutes, checked_at - age AS since, known, i FROM c),
 s AS (SELECT device_id, 0::BIGINT AS i, 0::BIGINT AS checked_at, '' AS status, 0::BIGINT AS minutes, 0::BIGINT AS level, 0::BIGINT AS first, 0::BIGINT AS shown FROM m GROUP BY 1
  UNION ALL SELECT device_id, n, now_ms, CASE WHEN fresh THEN CASE WHEN level > 0 THEN 'recovered' ELSE 'fresh' END WHEN now >= next THEN 'alerted' ELSE 'below-level' END, now,
   CASE WHEN fresh THEN 0 WHEN now >= next THEN next ELSE level END, CASE WHEN fresh AND level > 0 THEN 0 WHEN fresh THEN first WHEN first = 0 THEN since ELSE first END,
   CASE WHEN fresh THEN first WHEN first = 0 THEN since ELSE first END
  FROM (SELECT s.device_id, m.i AS n, m.checked_at AS now_ms, m.minutes AS now, m.since, m.known AND m.minutes < 5 AS fresh, s.level, s.first, {_NEXT} AS next FROM s JOIN m ON m.device_id = s.device_id AND m.i = s.i + 1) x)"""


@query(f"WITH RECURSIVE {_ALERTS} SELECT device_id, checked_at, status, minutes AS stale_minutes, level, shown AS first_stale_at FROM s WHERE i > 0")
def stale_alerts(spark, sf):
    """A check just before each reading of each device, folded by the alert state machine."""
    from .streaming import staleness

    g = series.gaps(readings(spark, sf).select("device_id", "ms"))
    return staleness.alerts(g.select("device_id", (F.col("ms") - 1).alias("checked_at"), F.col("previous_ms").alias("last_at")))


_CHECKS = "SELECT o_custkey % 40 AS device_id, epoch_ms(o_orderdate) + (o_orderkey % 3) * 86400000 * 20 + CASE WHEN o_orderkey % 5 = 0 THEN 60000 ELSE 7200000 END AS checked_at FROM orders"


@query(f"""WITH checks AS ({_CHECKS}), files AS (SELECT o_custkey % 40 AS device_id, strftime(o_orderdate, '%Y-%m') AS month, max(epoch_ms(o_orderdate)) AS w FROM orders WHERE o_orderkey % 11 < 2 GROUP BY 1, 2),
 d AS (SELECT *, strftime(epoch_ms(checked_at), '%Y-%m') AS m, strftime(epoch_ms(checked_at) - INTERVAL 1 MONTH, '%Y-%m') AS p, checked_at - epoch_ms(date_trunc('month', epoch_ms(checked_at))::TIMESTAMP) < 300000 AS early FROM checks)
 SELECT d.device_id, checked_at, CASE WHEN a.w IS NOT NULL THEN a.w WHEN early OR b.w IS NULL THEN -1 ELSE b.w END AS last_at, CASE WHEN a.w IS NOT NULL THEN 'current' WHEN early THEN 'too-early' WHEN b.w IS NOT NULL THEN 'previous' ELSE 'none' END AS source
 FROM d LEFT JOIN files a ON a.device_id = d.device_id AND a.month = m LEFT JOIN files b ON b.device_id = d.device_id AND b.month = p""")
def stale_sources(spark, sf):
    """Checks over years, resolved to the month file that they may rest on."""
    from .streaming import staleness

    o = load(spark, sf, "orders").withColumn("device_id", F.col("o_custkey") % 40)
    late = F.when(F.col("o_orderkey") % 5 == 0, 60_000).otherwise(7_200_000)
    checks = o.select("device_id", (epoch_ms("o_orderdate") + (F.col("o_orderkey") % 3) * DAY * 20 + late).alias("checked_at"))
    files = o.where("o_orderkey % 11 < 2").groupBy("device_id", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.max(epoch_ms("o_orderdate")).alias("written_at"))
    return staleness.last_seen(checks, files).withColumn("last_at", F.coalesce("last_at", F.lit(-1).cast("long")))


@query("SELECT event_id, user_id AS device_id, epoch_us(ts) // 1000 AS ms FROM events")
def stream_dedupe(spark, sf):
    """Every event arrives twice; each is kept once."""
    from .streaming import ingest as stream

    path = _scratch(spark, "stream-dedupe")
    doubled = _stream(spark, sf).select("device_id", "timestamp", "event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    unique = stream.unique(doubled, ["event_id"], "timestamp", "60 days")
    q = unique.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "device_id", epoch_ms("timestamp").alias("ms"))


@query(f"WITH {READINGS} SELECT device_id, {fixed(DAY)} AS ts, count(*) AS n, round(sum({V})::DOUBLE, 2) AS total FROM readings GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    """Daily windows of a stream, kept in their last state by a sink that merges."""
    from .streaming import ingest as stream

    path = _scratch(spark, "stream-tumbling")
    windows = stream.tumbling(_stream(spark, sf), "timestamp", "1 day", {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")})
    keep = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/rows/b={i}")
    q = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = ingest.dedupe(spark.read.parquet(f"{path}/rows").drop("b"), ["device_id", "start"], [F.col("batch")], "last")
    return rows.select("device_id", F.unix_millis("start").alias("ts"), "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

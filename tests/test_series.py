import json
import time
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions.durations import Duration
from tidemark.functions.monoid import Metric
from tidemark.operators import analytics, ingest, joins, registry, rollup, series
from tidemark.operators import devices as device_table
from tidemark.plans import build
from tidemark.plans import query as q
from tidemark.plans.cover import min_cover
from tidemark.plans.pyramid import Pyramid, default_pyramid
from tidemark.sources import commits, files, rest
from tidemark.streaming import deltas, staleness
from tidemark.streaming import ingest as stream

M = Metric("v", "v")


def rows(spark, data, schema="device_id long, timestamp timestamp, v string"):
    return spark.createDataFrame(data, schema)


def test_raw_state_of_odd_values(spark):
    at = lambda *a: datetime(2024, 1, 1, *a)
    df = rows(spark, [(1, at(0, 0), "1"), (1, at(0, 0, 30), "x"), (1, at(0, 1), None), (1, at(0, 2), "NaN"), (1, datetime(1969, 12, 31, 23, 59, 30), "2")])
    out = {r["ts"]: (r["v_n"], r["v_sum"], r["v_sumsq"]) for r in rollup.aggregate_raw(df, "1min", [M]).collect()}
    base = 1_704_067_200_000
    assert out == {base: (1, 1.0, 1.0), base + 60_000: (0, 0.0, 0.0), base + 120_000: (0, 0.0, 0.0), -60_000: (1, 2.0, 4.0)}
    assert rollup.aggregate_raw(df.limit(0), "1min", [M]).count() == 0


def test_coarsen_needs_division(spark):
    with pytest.raises(ValueError):
        rollup.coarsen(spark.range(0), "3min", "10min", [M])


def test_sources_of_tiers():
    p = default_pyramid([{"name": "v"}])
    assert [getattr(p.source_of(t.name), "name", None) for t in p.tiers] == [None, "raw", "raw", "m10", "m30", "h2", "h6"]
    for bad in ({"metrics": [{"name": "v", "monoid": "no"}], "tiers": [{"name": "a", "bin": "1d", "shards": ["4d"]}]}, {"metrics": [{"name": "v"}], "tiers": [{"name": "a", "bin": "1d", "shards": ["3d", "4d"]}]}):
        with pytest.raises(ValueError):
            Pyramid.of(bad)
    with pytest.raises(ValueError):
        Metric("v", "v", "median")


def test_tier_choice_and_smoothing():
    p = default_pyramid([{"name": "v"}])
    month = 31 * 86_400_000
    assert [q.choose_tier(p, month, b) for b in (10, 50, 200, 1000, 50_000)] == ["d1", "d1", "h6", "h2", "raw"]
    b = p.tier("h2").bin
    assert q.smoothing_of(0, b).bins == 51 and q.smoothing_of("auto", b, "trailing").bins == 50
    assert q.smoothing_of("10h", b).bins == 5 and q.smoothing_of(1, b) is None


def test_splice_below_several_stale_tiers(spark):
    p, hour, day = default_pyramid([{"name": "v"}]), 3_600_000, 86_400_000
    readings = spark.range(0, 7 * 144).select((F.col("id") % 2).alias("device_id"), F.timestamp_millis(F.col("id") * 600_000).alias("timestamp"), F.col("id").cast("double").alias("v"))
    tiers = {n: t.cache() for n, t in q.build_tiers(p, readings).items()}
    want = sorted(map(tuple, tiers["h6"].collect()))
    for fresh in ({"h6": 3 * day, "h2": 3 * day}, {"h6": 3 * day, "h2": 3 * day + 5 * hour, "m30": 5 * day + hour, "m10": 6 * day + 1}, {"h6": 0, "h2": 0, "m30": 0, "m10": 0}):
        held = {n: t.where(F.col("ts") + p.tier(n).bin.ms <= fresh.get(n, 8 * day)) for n, t in tiers.items()}
        plan = q.plan_query(p, 0, 7 * day, 30, fresh)
        assert plan.output_tier == "h6" and plan.segments[0].start == 0 and plan.segments[-1].end == 7 * day
        assert sorted(map(tuple, q.execute(plan, p, held, 0, 7 * day).collect())) == want


def test_previous_over_chunks(spark):
    df = spark.createDataFrame([(1, t) for t in (5, 7, 25, 26, 99)] + [(2, 50)], "d long, t long")
    out = {(r["d"], r["t"]): r["previous"] for r in series.previous(df, "t", ["d"], F.floor(F.col("t") / 10)).collect()}
    assert out == {(1, 5): None, (1, 7): 5, (1, 25): 7, (1, 26): 25, (1, 99): 26, (2, 50): None}


def test_moving_sums_over_chunks(spark):
    times = list(range(0, 200, 7))
    df = spark.createDataFrame([(1, t, float(t)) for t in times], "d long, t long, v double")
    out = {r["t"]: r["s"] for r in series.moving_sums(df, "t", ["d"], {"s": F.col("v")}, 20, 10, chunk=30).collect()}
    assert out == {t: float(sum(x for x in times if t - 20 <= x <= t + 10)) for t in times}


def test_gap_of_three_widths_is_none(spark):
    df = spark.createDataFrame([(1, 0, 1, 1.0), (1, 30, 1, 1.0), (1, 61, 1, 1.0)], "device_id long, ts long, count long, v double")
    marks = [r for r in series.gap_markers(df, 10, ["v"]).collect() if r["count"] == 0]
    assert [(r["ts"], r["v"]) for r in marks] == [(40, None)]


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(2, 3.0), (3, 4.0)], "k long, v double")
    get = lambda how: {r["k"]: r["v"] for r in ingest.merge(old, new, ["k"], ["v"], how).collect()}
    assert get("warn") == {1: 1.0, 2: 2.0, 3: 4.0}
    assert get("replace") == {1: 1.0, 2: 3.0, 3: 4.0}
    with pytest.raises(ValueError):
        get("error")
    assert ingest.inserted(old, new, ["k"]) == 1


def test_devices(spark):
    devices = spark.createDataFrame([(41, "Attic"), (90210, "Shed"), (5, "Attic 2")], "device_id long, name string")
    assert analytics.resolve_device(devices, "41") == 41 and analytics.resolve_device(devices, "shed") == 90210
    with pytest.raises(LookupError):
        analytics.resolve_device(devices, "attic")
    assert analytics.find_device(devices, "attic") == 41 and analytics.find_device(devices, "tic") is None
    page, total, more = analytics.search(devices, "name", ["a", "c"], ["device_id"], 0, 1)
    assert (page.count(), total, more) == (1, 2, True)


def test_the_device_list_is_kept(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return [{"device_id": 7, "name": f"n{len(calls)}", "active": False}, {"device_id": 8, "name": "m"}]

    path, get = str(tmp_path / "devices"), lambda **k: {r["device_id"]: r["name"] for r in device_table.listed(spark, path, fetch, **k).collect()}
    assert get(now=1_000) == {7: "n1", 8: "m"} == get(now=3_600_000)
    assert get(now=3_602_000) == {7: "n2", 8: "m"} and get(now=3_602_000, refresh=True) == {7: "n3", 8: "m"}
    own = spark.createDataFrame([(8, "mine"), (7, None)], "device_id long, name string")
    assert get(now=3_602_000, overrides=own) == {7: "n3", 8: "mine"}
    held = device_table.listed(spark, path, fetch, now=3_602_000)
    assert [r["device_id"] for r in device_table.active(held).collect()] == [8]
    assert {r["device_id"] for r in device_table.listed(spark, "/proc/none/devices", fetch, now=1).collect()} == {7, 8}


def test_upsert_keeps_what_is_new(spark):
    schema = "device_id long, tier string, rung string, period_start long, period_end long, written_at long, size_bytes long"
    old = spark.createDataFrame([(1, "raw", "1d", 0, 1, 10, 7), (1, "raw", "1d", 1, 2, 10, 8)], schema)
    new = spark.createDataFrame([(1, "raw", "1d", 0, 1, 20, None)], schema)
    out = {r["period_start"]: (r["written_at"], r["size_bytes"]) for r in registry.upsert(old, new).collect()}
    assert out == {0: (20, 7), 1: (10, 8)}


def test_alert_levels(spark):
    minutes = [1, 6, 16, 61, 121, 125, 1, 2]
    checks = [(1, 10**12 + i, 10**12 + i - m * 60_000) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(checks, "device_id long, checked_at long, last_at long")
    out = [(r["status"], r["level"]) for r in staleness.alerts(df).orderBy("checked_at").collect()]
    assert out == [("fresh", 0), ("alerted", 5), ("alerted", 15), ("alerted", 60), ("alerted", 120), ("below-level", 120), ("recovered", 0), ("fresh", 0)]
    assert [staleness.next_level(x) for x in (0, 5, 15, 60, 360, 1440, 10_080)] == [5, 15, 60, 120, 480, 1800, 11_520]


def test_alerts_over_chunks_equal_one_fold(spark):
    import random

    pick, rows = random.Random(4), []
    start = 1_704_067_200_000 - 40 * 86_400_000
    for device, step in ((1, 600), (2, 7_000), (3, 90_000), (None, 50_000)):
        times = sorted(pick.sample(range(0, 60 * 86_400, 7), 60 * 86_400 // step // 2))
        for t in [*times, 31 * 86_400 + 60]:
            stale = pick.choice([0, 2, 7, 20, 70, 130, 800, 3_000, 20_000]) if device != 3 else 20_000
            now = start + t * 1000 + 1
            rows.append((device, now, None if pick.random() < 0.1 else now - stale * 60_000))
        rows += [(device, 1_704_067_200_001, None)]  # under five minutes into a month: below any level
    df = spark.createDataFrame(rows, "device_id long, checked_at long, last_at long").repartition(5).dropDuplicates(["device_id", "checked_at"])
    want = []
    for device in (1, 2, 3, None):
        own = sorted((r["checked_at"], r["last_at"]) for r in df.collect() if r["device_id"] == device)
        want += [(device, *r) for r in staleness.fold(iter(own), staleness.AlertState())[0]]
    out = staleness.alerts(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no device is one group
    assert staleness.alerts(df.limit(0)).count() == 0


def test_alert_stream_equals_batch(spark, tmp_path):
    checks = [(d, 10**12 + i * 60_000, 10**12 - d * 60_000 * 3) for d in (1, 2, 3) for i in range(40)]
    df = spark.createDataFrame(checks, "device_id long, checked_at long, last_at long")
    want = {tuple(r) for r in staleness.alerts(df).collect()}
    half = 10**12 + 20 * 60_000
    for i, part in enumerate((df.where(F.col("checked_at") < half), df.where(F.col("checked_at") >= half))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    s = staleness.alert_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    s.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_files(spark, tmp_path):
    state = spark.createDataFrame([(d, i * 60_000, 1, 1.0, 1.0) for d in (1, 2) for i in range(2000)], "device_id long, ts long, v_n long, v_sum double, v_sumsq double")
    tier = default_pyramid([{"name": "v"}]).tier("raw")
    files.write_tier(state, str(tmp_path / "t"), tier, 1, row_group_rows=1000)
    back = files.read_tier(spark, str(tmp_path / "t"), tier, [M], 60_000, 86_400_000)
    assert back.count() == 2 * 1439
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "PartitionFilters: [isnotnull(part" in plan
    stats = files.footers(spark, str(tmp_path / "t")).collect()
    assert sum(r["n_rows"] for r in stats) == 4000 and max(max(r["rg_row_counts"]) for r in stats) == 1000
    assert all(sum(r["rg_row_counts"]) == r["n_rows"] and len(r["rg_row_counts"]) == r["n_rgs"] for r in stats)
    assert files.row_group_length(spark, stats[0]["path"]) == stats[0]["rg_row_counts"][0] and files.row_group_length(spark, str(tmp_path / "no")) is None
    one = files.head(spark, stats[0]["path"])
    assert one["size_bytes"] == stats[0]["size_bytes"] and files.head(spark, str(tmp_path / "no")) is None
    assert files.tiers_written(spark, str(tmp_path / "t")) == {"raw": max(r["written_at"] for r in files.listing(spark, str(tmp_path / "t")).collect())}
    files.rewrite(spark, str(tmp_path / "t/tier=raw"), str(tmp_path / "r"), 500)
    assert max(max(r["rg_row_counts"]) for r in files.footers(spark, str(tmp_path / "r")).collect()) == 500
    assert files.read_or_empty(spark, str(tmp_path / "none"), files.READING_SCHEMA).count() == 0
    assert files.listing(spark, str(tmp_path / "t")).count() == len(stats) and files.listing(spark, str(tmp_path / "none")).count() == 0


def test_footers_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    want = [tuple(r) for r in files.footers(spark, str(tmp_path / "t")).collect()]
    monkeypatch.setattr(files, "KNOWN_STORES", "^none:")
    assert [tuple(r) for r in files.footers(spark, str(tmp_path / "t")).collect()] == want and want[0][2] == 100


def test_keys_go_round(spark):
    p = default_pyramid([{"name": "v"}])
    key = p.format_key(7, "raw", "1d", "2024-01-01")
    with pytest.raises(ValueError):
        p.format_key(7, "raw", "4d", "2024-01-01")
    keys = spark.createDataFrame([(f"s3://b/x/{key}",), ("x/other.parquet",), ("device-x/raw/1d/2024-01-01.parquet",)], "path string")
    assert [tuple(r)[1:] for r in files.parse_keys(keys).collect()] == [(7, "raw", "1d", "2024-01-01")]
    other = spark.createDataFrame([("a/raw.1d/9_2024.parquet",)], "path string")
    assert [tuple(r)[1:] for r in files.parse_keys(other, key="{tier}.{shard}/{device_id}_{period}.parquet").collect()] == [(9, "raw", "1d", "2024")]


def test_registry_from_files(spark, tmp_path):
    p = default_pyramid([{"name": "v"}])
    for tier, shard, label in (("raw", "1d", "2024-01-02"), ("raw", "1mo", "2024-02"), ("m10", "4d", "2024-01-05")):
        spark.range(1).coalesce(1).write.parquet(str(tmp_path / "staging"), mode="overwrite")
        target = tmp_path / p.format_key(12, tier, shard, label)
        target.parent.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "staging").glob("*.parquet")).rename(target)
    (tmp_path / "device-12/raw/1d/oops.parquet").write_bytes(target.read_bytes())
    out = files.bootstrap_registry(spark, str(tmp_path), {"raw": ["1d", "1mo"], "m10": ["1d"]}).orderBy("period_start").collect()
    day = 86_400_000
    assert [(r["device_id"], r["tier"], r["rung"], r["period_end"] - r["period_start"]) for r in out] == [(12, "raw", "1d", day), (12, "raw", "1mo", 29 * day)]


def test_monthly_files(spark, tmp_path):
    at = lambda m, d, h=0: datetime(2024, m, d, h)
    schema = "timestamp timestamp, v double"
    rows = spark.createDataFrame([(at(1, 5), 1.0), (at(1, 28), 2.0), (at(2, 3), 3.0)], schema)
    base = str(tmp_path / "m")
    files.write_monthly(rows, base)
    assert sorted(x.name for x in (tmp_path / "m").glob("month=*")) == ["month=2024-01", "month=2024-02"]
    merge = lambda data, how="warn": files.merge_monthly(spark, base, spark.createDataFrame(data, schema), ["timestamp"], ["v"], on_conflict=how)
    base = str(tmp_path / "merged")
    table = files.monthly_table(spark, base, rows.schema)
    held = lambda: sorted(tuple(r) for r in table.read().select("timestamp", "v").collect())
    assert merge(rows.collect())
    folder = lambda: {r["month"]: r["folder"] for r in table.manifest().collect()}
    february = folder()["2024-02"]
    assert not merge([(at(1, 5), 1.0), (at(1, 28), 9.0)])  # nothing new, and a conflict that is left
    assert merge([(at(1, 28), 9.0), (at(1, 9), 4.0)], "replace")
    assert held() == [(at(1, 5), 1.0), (at(1, 9), 4.0), (at(1, 28), 9.0), (at(2, 3), 3.0)]
    assert folder()["2024-02"] == february  # untouched
    assert merge([(at(3, 1), 5.0)]) and len(held()) == 5
    with pytest.raises(commits.StaleVersion):
        files.merge_monthly(spark, base, rows.withColumn("v", F.lit(0.5)), ["timestamp"], ["v"], on_conflict="replace", expected=1)
    assert len(held()) == 5


def test_a_devices_readings(spark, tmp_path):
    schema = "timestamp timestamp, v double"
    for name, day in (("2024-02", 1), ("2024-01", 2), ("notes", 3)):
        (tmp_path / "device-9").mkdir(exist_ok=True)
        spark.createDataFrame([(datetime(2024, 1, day), float(day))], schema).toPandas().to_parquet(tmp_path / f"device-9/{name}.parquet", coerce_timestamps="us")
    spark.createDataFrame([(datetime(2023, 1, 1), 7.0)], schema).toPandas().to_parquet(tmp_path / "device-8.parquet", coerce_timestamps="us")
    kind = spark.createDataFrame([], schema).schema
    assert [x.rsplit("/", 1)[1] for x in files.monthly_files(spark, str(tmp_path / "device-9"))] == ["2024-01.parquet", "2024-02.parquet"]
    assert files.monthly_files(spark, str(tmp_path / "none")) == []
    assert [r["v"] for r in files.read_monthly(spark, str(tmp_path / "device-9"), kind, "timestamp").collect()] == [1.0, 2.0]
    get = lambda n: [r["v"] for r in files.read_device(spark, str(tmp_path / n), kind).collect()]
    assert sorted(get("device-9")) == [1.0, 2.0] and get("device-8") == [7.0] and get("device-7") == []
    named = files.with_device(files.read_monthly(spark, str(tmp_path / "device-9"), kind))
    assert {r["device_id"] for r in named.collect()} == {9}


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1), None)], "timestamp timestamp, v double").coalesce(1)
    assert json.loads(files.json_rows(df).first()["json"]) == {"timestamp": "2024-01-01T00:00:00.000Z", "v": None}
    files.write_json_lines(df, str(tmp_path / "j"))
    assert [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()] == [{"timestamp": "2024-01-01T00:00:00.000Z", "v": None}]


def test_pages(spark):
    page = '{"data":[{"timestamp":"2024-07-05T22:22:06.331Z","sensors":[{"comp":"temp","value":71.5},{"comp":"co2","value":612}]}]}'
    out = rest.flatten(spark.createDataFrame([(page,)], "p string"), F.col("p"), ["temp", "co2", "voc"]).first()
    assert (out["temp"], out["co2"], out["voc"]) == (71.5, 612.0, None)


def test_rest_source(spark):
    spark.dataSource.register(rest.ReadingsSource)
    df = spark.read.format("readings").options(**{"pages": "tests.pages:fetch", "devices": "1,2", "from": 0, "to": 7_200_000, "slice_hours": 1, "limit": 7}).load()
    assert df.groupBy("device_id").count().orderBy("device_id").collect() == [(1, 120), (2, 120)]
    assert df.select("timestamp").distinct().count() == 120
    held = spark.createDataFrame([(datetime(1970, 1, 1, 0, 30), 1.0), (datetime(1970, 1, 2), 2.0)], "timestamp timestamp, value double")
    assert rest.replace_range(held, df.where("device_id = 1").select("timestamp", "value"), 0, 7_200_000).count() == 121


def test_rest_outcomes(spark):
    spark.dataSource.register(rest.RequestsSource)
    spark.dataSource.register(rest.ReadingsSource)
    options = {"devices": "1", "from": 0, "to": 5 * 3_600_000, "limit": 60}
    load = lambda kind, **k: spark.read.format(kind).options(**options, **k).load()
    rows = [tuple(r) for r in load("reading_requests", pages="tests.pages:shaky").collect()]
    assert [r[3] for r in rows] == ["ok", "http_error", "ok", "ok", "rate_limit"] and rows[0][1:3] == (0, 18_000_000)
    assert rows[0][4:] == (60, 14_400_000, 17_940_000, 60.0)
    assert rows[2][2] == rows[1][2] - 3_600_000  # an hour back after an error
    assert [r[3] for r in load("reading_requests", pages="tests.pages:shaky", max_requests=2).collect()] == ["ok", "http_error"]
    assert load("readings", pages="tests.pages:shaky").count() == 180
    with pytest.raises(Exception):
        load("readings", pages="tests.pages:shaky", on_rate_limit="fail").count()


def test_scans_get_the_range(spark, sf_dir):
    from tidemark.queries import queries

    for name in ("plan_budget_10", "plan_budget_50000", "pruned_scan", "splice_tail", "smooth_centered"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "PushedFilters" in x]
        assert scans and all("GreaterThanOrEqual(ts," in x and "LessThan(ts," in x for x in scans)


CALENDAR = {"metrics": [{"name": "v"}], "tiers": [{"name": "d", "bin": "1d", "shards": ["1mo"]}, {"name": "m", "bin": "1mo", "shards": ["1y"]}, {"name": "y", "bin": "1y", "shards": ["10y"]}]}


def test_calendar_tiers_plan_and_smooth(spark):
    p, day = Pyramid.of(CALENDAR), 86_400_000
    assert [getattr(p.source_of(t.name), "name", None) for t in p.tiers] == [None, "d", "m"]
    assert [q.choose_tier(p, 366 * day, b, 1_704_067_200_000) for b in (1, 11, 12, 365, 366)] == ["y", "y", "m", "m", "d"]
    readings = spark.range(0, 800).select(F.lit(1).alias("device_id"), F.timestamp_millis(1_704_067_200_000 + F.col("id") * day).alias("timestamp"), F.lit(1.0).alias("v"))
    tiers = q.build_tiers(p, readings)
    start, end = 1_706_745_600_000, 1_730_419_200_000  # February to October of 2024
    plan = q.plan_query(p, start, end, 20, {"m": 1_719_792_000_000 + 5}, smooth="auto3")
    assert plan.output_tier == "m" and [s.tier for s in plan.segments] == ["m", "d"] and plan.segments[0].end == 1_719_792_000_000
    out = q.execute(plan, p, tiers, start, end).orderBy("ts").collect()
    assert [r["v_n"] for r in out] == [29, 31, 30, 31, 30, 31, 31, 30, 31]
    assert [r["v_smooth_n"] for r in out][:3] == [91, 90, 92] and out[0]["ts"] == start


def test_a_plan_from_shards():
    p, hour, day = default_pyramid([{"name": "v"}]), 3_600_000, 86_400_000
    plan = lambda shards: [(s.tier, s.start, s.end, s.reaggregate) for s in q.plan_from_inventory(p, 0, 7 * day, 30, shards).segments]
    assert plan([("h6", "16d", 0, 3 * day), ("h6", "128d", day, 8 * day)]) == [("h6", 0, 7 * day, False)]
    assert plan([("h6", "16d", 0, 2 * day + hour), ("h2", "16d", 0, 4 * day), ("h2", "128d", day, 5 * day), ("raw", "1d", 6 * day, 7 * day)]) == [("h6", 0, 2 * day, False), ("h2", 2 * day, 5 * day, True), ("raw", 6 * day, 7 * day, True)]
    assert plan([]) == []


def test_freshness_is_the_laggards(spark):
    rows = spark.createDataFrame([(1, "raw", 50), (1, "raw", 70), (2, "raw", 60), (1, "h6", 30)], "device_id long, tier string, period_end long")
    assert q.freshness(rows) == {"raw": 60, "h6": 30} and q.freshness(rows, [1]) == {"raw": 70, "h6": 30}


def test_lists_of_odd_values(spark):
    metrics = [Metric("t", "v", "topk", k=2), Metric("b", "v", "botk", k=2), Metric("h", "v", "histogram", width=10.0), Metric("n", "v", "count")]
    at = datetime(2024, 1, 1)
    df = rows(spark, [(1, at, x) for x in ("3", "12", "x", None, "NaN", "25", "12")] + [(None, at, "7"), (2, at, "none")])
    out = {r["device_id"]: (r["t_topk"], r["b_botk"], r["h_histogram"], r["n_n"]) for r in rollup.aggregate_raw(df, "1d", metrics).collect()}
    assert out == {1: ([25.0, 12.0], [3.0, 12.0], {0: 1, 1: 2, 2: 1}, 4), None: ([7.0], [7.0], {0: 1}, 1), 2: ([], [], {}, 0)}
    two = rollup.aggregate_raw(df, "1d", metrics).unionByName(rollup.aggregate_raw(df, "1d", metrics))
    merged = {r["device_id"]: (r["t_topk"], r["b_botk"], r["h_histogram"], r["n_n"]) for r in rollup.stitch([two, two.limit(0)], metrics).collect()}
    assert merged == {1: ([25.0, 25.0], [3.0, 3.0], {0: 2, 1: 4, 2: 2}, 8), None: ([7.0, 7.0], [7.0, 7.0], {0: 2}, 2), 2: ([], [], {}, 0)}
    assert rollup.aggregate_raw(df.limit(0), "1d", metrics).count() == 0


def test_one_shard_is_built(spark, tmp_path):
    p, base = Pyramid.of(CALENDAR | {"tiers": [{"name": "d", "bin": "1d", "shards": ["1d", "1mo"]}, {"name": "m", "bin": "1mo", "shards": ["1y"]}]}), str(tmp_path / "p")
    days = [datetime(2024, 1, 3), datetime(2024, 1, 9), datetime(2024, 2, 1)]
    readings = spark.createDataFrame([(1, d, 2.0) for d in days], "device_id long, timestamp timestamp, v double")
    assert build.build_shard(p, readings, base, "d", "1mo", "2024-01") == build.Built("written", 2, 31)
    assert build.build_shard(p, readings, base, "m", "1y", "2024") == build.Built("written", 2, 366)
    assert build.build_shard(p, readings, base, "d", "1mo", "2023-01") == build.Built("no_inputs", 0, 31)
    assert [r["v_n"] for r in build.tier(p, spark, base, "m").collect()] == [2]  # February's day isn't built yet
    with pytest.raises(ValueError):
        build.build_shard(p, readings, base, "d", "1y", "2024")


def test_converging_reports_failures_and_time(spark, tmp_path):
    p, day = Pyramid.of({"metrics": [{"name": "v"}], "tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["1d"]}]}), 86_400_000
    readings = spark.createDataFrame([(1, datetime(2024, 1, d), 1.0) for d in (1, 2)], "device_id long, timestamp timestamp, v double")
    devices = spark.createDataFrame([(1, 1_704_067_200_000)], "device_id long, genesis long")
    nothing = spark.createDataFrame([], "device_id long, tier string, rung string, period_start long, period_end long, written_at long")
    journal = spark.createDataFrame([], "start long, end long, requested_at long")
    go = lambda **k: build.converge(p, devices, nothing, journal, readings.withColumnRenamed("v", k.pop("name", "v")), str(tmp_path / "c"), 1_704_067_200_000 + 2 * day, **k)
    statuses = lambda run: sorted((r["tier"], r["status"]) for r in run.slots.select("tier", "status").distinct().collect())
    plan = go(dry_run=True)
    assert [r[:2] for r in plan.results] == [("h6", "due"), ("d1", "due")] and plan.registry.count() == 0 and build.tier(p, spark, str(tmp_path / "c"), "h6").count() == 0
    assert statuses(plan) == [("d1", "no_inputs"), ("h6", "due")]  # the coarser tier's inputs aren't built
    broken = go(name="w")
    assert broken.results[0][1].startswith("failed") and statuses(broken) == [("d1", "held"), ("h6", "failed")]
    assert broken.registry.count() == 0 and build.tier(p, spark, str(tmp_path / "c"), "d1").count() == 0
    run = go()
    assert [r[:2] for r in run.results] == [("h6", "written"), ("d1", "written")] and run.registry.count() == 4
    assert statuses(run) == [("d1", "written"), ("h6", "written")]
    assert [r[:2] for r in go(budget_s=0.0).results] == [("h6", "skipped"), ("d1", "skipped")]
    again = build.backfill_missing(p, devices, run.registry, readings, str(tmp_path / "c"), 1_704_067_200_000 + 2 * day)
    assert again.slots.count() == 0 and again.registry.count() == 4
    forced = build.backfill_missing(p, devices, run.registry, readings, str(tmp_path / "c"), 1_704_067_200_000 + 2 * day, force=True)
    assert statuses(forced) == [("d1", "written"), ("h6", "written")]


def test_failing_devices_hold_back_no_others(spark, tmp_path):
    day, t0 = 86_400_000, 1_704_153_600_000
    of = lambda value: Pyramid.of({"metrics": [{"name": "v", "value": value}], "tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["1d", "2d"]}]})
    readings = spark.createDataFrame([(d, datetime(2024, 1, n), 1.0) for d in range(40) for n in (2, 3) if (d, n) != (9, 3)], "device_id long, timestamp timestamp, v double")
    devices = spark.createDataFrame([(d, t0) for d in range(41)], "device_id long, genesis long")  # device 40 has no readings
    nothing = spark.createDataFrame([], "device_id long, tier string, rung string, period_start long, period_end long, written_at long")
    journal = spark.createDataFrame([], "start long, end long, requested_at long")
    go = lambda p, held: build.converge(p, devices, held, journal, readings, str(tmp_path / "c"), t0 + 2 * day, 600.0)
    run = go(of("if(device_id = 5, raise_error('broken'), v)"), nothing)
    slots = {(r["device_id"], r["tier"], r["period_start"]): r["status"] for r in run.slots.collect()}
    beside = {r["device_id"] for r in devices.where(files.bucket_of() == devices.where("device_id = 5").select(files.bucket_of()).first()[0]).collect()}
    assert 5 in beside and len(beside) < 20
    for d in range(41):
        fine, coarse = slots[d, "h6", t0], slots[d, "d1", t0]
        assert (fine, coarse) == (("no_inputs", "held" if d in beside else "no_inputs") if d == 40 else ("failed", "held") if d in beside else ("written", "partial" if d == 9 else "written"))
    assert slots[9, "h6", t0 + day] in ("no_inputs", "failed")
    healed = go(of("v"), run.registry)
    recorded = {(r["device_id"], r["tier"], r["period_start"]) for r in healed.registry.collect()}
    assert recorded == {(d, "h6", t0 + n * day) for d in range(40) for n in (0, 1) if (d, n) != (9, 1)} | {(d, "d1", t0) for d in range(40) if d != 9}
    assert build.tier(of("v"), spark, str(tmp_path / "c"), "d1").agg(F.sum("v_n")).first()[0] == 79


def test_convergence_keeps_its_registry(spark, tmp_path):
    """What a run leaves is read, not found again from all tiers and runs before."""
    day, t0 = 86_400_000, 1_704_153_600_000
    p = Pyramid.of({"metrics": [{"name": "v"}], "tiers": [{"name": "h6", "bin": "6h", "shards": ["1d"]}, {"name": "d1", "bin": "1d", "shards": ["1d", "2d"]}]})
    readings = spark.createDataFrame([(d, datetime(2024, 1, n), 1.0) for d in (1, 2) for n in (2, 3) if (d, n) != (2, 2)], "device_id long, timestamp timestamp, v double")
    devices = spark.createDataFrame([(1, t0), (2, t0), (3, t0)], "device_id long, genesis long")
    nothing = spark.createDataFrame([], "device_id long, tier string, rung string, period_start long, period_end long, written_at long")
    journal = spark.createDataFrame([], "start long, end long, requested_at long")
    run = build.converge(p, devices, nothing, journal, readings, str(tmp_path / "c"), t0 + 2 * day, 600.0)
    assert run.registry.inputFiles() and all("registry=d1" in f for f in run.registry.inputFiles())
    assert sorted((r["device_id"], r["tier"], r["period_start"]) for r in run.registry.collect()) == [(1, "d1", t0), (1, "h6", t0), (1, "h6", t0 + day), (2, "h6", t0 + day)]
    counts = {(r["device_id"], r["tier"], r["period_start"]): (r["inputs_present"], r["inputs_expected"], r["status"]) for r in run.slots.where("device_id > 1").collect()}
    assert counts == {(2, "h6", t0): (0, 1, "no_inputs"), (2, "h6", t0 + day): (1, 1, "written"), (2, "d1", t0): (1, 2, "partial"), (3, "h6", t0): (0, 1, "no_inputs"), (3, "h6", t0 + day): (0, 1, "no_inputs"), (3, "d1", t0): (0, 2, "no_inputs")}


def table_at(spark, path):
    schema = spark.createDataFrame([], "device_id long, v double, month string").schema
    return commits.Versioned(spark, str(path), schema, ("month",))


def test_commits(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "device_id long, v double, month string")
    held = lambda v=None: sorted(tuple(r) for r in table.read(v).collect())
    assert table.version() == 0 and held() == []
    assert table.commit(frame((1, 1.0, "a/b=c"), (2, 2.0, "a/b=c"), (1, 3.0, "2024-02"))) == 1
    assert table.commit(frame((2, 9.0, "a/b=c")), keys=["device_id", "month"]) == 2
    assert held() == [(1, 1.0, "a/b=c"), (1, 3.0, "2024-02"), (2, 9.0, "a/b=c")] and held(1) != held()
    # two writers of one month from one version: the second is told, and nothing of it shows
    assert table.commit(frame((1, 5.0, "2024-02")), expected=2) == 3
    with pytest.raises(commits.StaleVersion):
        table.commit(frame((1, 6.0, "2024-02")), expected=2)
    assert (1, 5.0, "2024-02") in held() and len(held()) == 3
    # what is replaced and not written goes; an empty table can be read
    table.commit(frame((3, 1.0, "2024-03")), replaced=F.col("month") < "2024-03")
    assert held() == [(1, 1.0, "a/b=c"), (2, 9.0, "a/b=c"), (3, 1.0, "2024-03")]
    before = held()
    assert table.vacuum() > 0 and held() == before and table.vacuum() == 0
    table.commit(frame(), replaced=F.lit(True))
    assert held() == []


def test_writers_of_different_partitions_both_win(spark, tmp_path, monkeypatch):
    mine, other = table_at(spark, tmp_path / "t"), table_at(spark, tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "device_id long, v double, month string")
    mine.commit(frame((1, 1.0, "x"), (1, 1.0, "y")))
    write = commits.Versioned._write

    def meanwhile(month):
        def slow(self, rows, folder, options):
            write(self, rows, folder, options)
            if self is mine:
                other.commit(frame((7, 7.0, month)))
        monkeypatch.setattr(commits.Versioned, "_write", slow)

    meanwhile("y")
    assert mine.commit(frame((2, 2.0, "x"))) == 3
    assert sorted(tuple(r) for r in mine.read().collect()) == [(2, 2.0, "x"), (7, 7.0, "y")]
    meanwhile("x")
    with pytest.raises(commits.StaleVersion):
        mine.commit(frame((3, 3.0, "x")))
    assert sorted(tuple(r) for r in mine.read().collect()) == [(7, 7.0, "x"), (7, 7.0, "y")]


def test_a_devices_shards_leave_others_alone(spark, tmp_path):
    p, base = default_pyramid([{"name": "v"}]), str(tmp_path / "s")
    state = spark.createDataFrame([(d, i * 3_600_000, 1, float(d), 1.0) for d in range(20) for i in range(30)], "device_id long, ts long, v_n long, v_sum double, v_sumsq double")
    for d in (1, 2, 1):
        build.write_shards(state.where(F.col("device_id") == d), base, "raw", "1d", buckets=1)
    rows = build.read_shards(spark, p, base, "raw", "1d")
    assert {(r["device_id"], r["count"]) for r in rows.groupBy("device_id").count().collect()} == {(1, 30), (2, 30)}
    with pytest.raises(commits.StaleVersion):
        build.write_shards(state, base, "raw", "1d", expected=1)


def test_streams_are_compacted_and_repaired(spark, tmp_path):
    path, day = str(tmp_path / "s"), 86_400_000
    frame = lambda data: spark.createDataFrame([(d, datetime(2024, 1, a, h), v) for d, a, h, v in data], "device_id long, timestamp timestamp, v double")
    send = lambda data, i, **k: stream.merge_batch(frame(data), i, path, "6h", [M], "timestamp", ["device_id", "timestamp"], "timestamp", **k)
    state = lambda: sorted((r["device_id"], r["ts"], r["v_n"], r["v_sum"]) for r in stream.current_bins(spark, path, [M]).collect())
    send([(1, 1, 0, 1.0), (1, 2, 7, 2.0)], 0)
    send([(1, 1, 1, 4.0), (1, 1, 0, 1.0)], 1)
    send([(1, 1, 1, 4.0), (1, 1, 0, 1.0)], 1)  # a retry
    jan1 = 1_704_067_200_000
    want = [(1, jan1, 2, 5.0), (1, jan1 + day + 6 * 3_600_000, 1, 2.0)]
    assert state() == want
    days = (jan1 // day, jan1 // day + 1)
    stream.compact(spark, path, days)
    assert state() == want and len(list((tmp_path / f"s/bins/day={days[0]}").glob("batch=*"))) == 1
    stream.compact(spark, path, days)
    send([(1, 1, 2, 8.0)], 2)
    assert state()[0] == (1, jan1, 3, 13.0)
    broken = [Metric("v", "no_such_column")]
    with pytest.raises(Exception):
        stream.merge_batch(frame([(1, 2, 8, 1.0)]), 3, path, "6h", broken, "timestamp", ["device_id", "timestamp"], "timestamp")
    stream.merge_batch(frame([(1, 2, 8, 1.0)]), 3, path, "6h", broken, "timestamp", ["device_id", "timestamp"], "timestamp", best_effort=True)
    assert state()[1] == want[1] and stream.repair(spark, path, "6h", [M]) and state()[1][2:] == (2, 3.0)
    assert not stream.repair(spark, str(tmp_path / "none"), "6h", [M])


@pytest.mark.parametrize("values", [(1.0, 9.0), (9.0, 1.0)])
def test_streams_keep_the_stored_reading(spark, tmp_path, values):
    path, day = str(tmp_path / "s"), 19_723
    send = lambda v, i: stream.merge_batch(spark.createDataFrame([(1, datetime(2024, 1, 1), v)], "device_id long, timestamp timestamp, v double"), i, path, "6h", [M], "timestamp", ["device_id", "timestamp"], "timestamp")
    held = lambda: [(r["v_n"], r["v_sum"]) for r in stream.current_bins(spark, path, [M]).collect()]
    send(values[0], 0)
    send(values[1], 1)
    assert held() == [(1, values[0])]
    stream.compact(spark, path, (day, day + 1))
    send(values[0], 0)  # old batches are sent again
    send(values[1], 1)
    send(values[1], 2)
    assert held() == [(1, values[0])]


def test_deltas_of_odd_batches(spark, tmp_path):
    path, schema = str(tmp_path / "d"), "device_id long, timestamp timestamp, id long, v double, seq int, gone boolean"
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    metric = Metric("v", "v", scale=1)

    def send(rows, replace=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arrived = spark.readStream.schema(schema).parquet(f"{path}/in")
        deltas.run(arrived, path, f"{path}/ck", "6h", [metric], ["id"], order="seq", deleted="gone", replace=replace, trigger={"availableNow": True}).awaitTermination()

    held = lambda: sorted((r["device_id"], r["ts"], r["v_n"], r["v_sum"], r["v_sumsq"]) for r in deltas.current_bins(spark, path, [metric]).collect())
    t0 = 1_704_067_200_000
    send([(1, at(0), 1, 1.5, 0, False), (1, at(1), 2, None, 0, False), (1, at(7), 3, float("nan"), 0, False), (2, at(0), 1, 2.0, 0, False), (2, at(0), 1, 3.0, 1, False)])
    want = [(1, t0, 1, 1.5, 2.25), (1, t0 + 21_600_000, 0, 0.0, 0.0), (2, t0, 1, 3.0, 9.0)]
    assert held() == want
    table = deltas.table(spark, path, [metric])
    state = table.read().where("batch = 0").drop("batch").collect()
    names = table.read().drop("batch").columns
    assert deltas.fold(spark, path, [metric], 0) and held() == want and len(state) == 3 and names[:3] == ["device_id", "ts", "readings"]
    send([(1, at(0), 1, 1.5, 0, False), (1, at(1), 2, 4.0, 0, False), (1, at(7), 3, None, 5, True), (2, at(0), 9, 1.0, 0, True)])  # equal, replaced, deleted, never held
    assert held() == [(1, t0, 2, 5.5, 18.25), want[2]]
    changes = table.read().where("batch = 1").count()
    assert changes == 2  # the bins that changed alone
    send([(2, at(0), 1, 8.0, 0, False), (2, at(0, 1), 2, 8.0, 0, False)], replace=False)
    assert held()[1] == (2, t0, 2, 11.0, 73.0)


def test_deltas_look_readings_up_together(spark, tmp_path):
    """No call of Python a bin: 2,000 bins of a reading each, some replaced, in batches without keyed state."""
    path, schema = str(tmp_path / "d"), "device_id long, timestamp timestamp, id long, v double, seq int, gone boolean"
    metric, rows = Metric("v", "v", scale=1), spark.range(2_000).selectExpr("id as device_id", "timestamp'2024-01-01 00:00:00' as timestamp", "id", "1.5D as v", "0 as seq", "false as gone")
    for own in (rows, rows.where("id < 500").withColumn("v", F.lit(2.5))):
        own.write.mode("append").parquet(f"{path}/in")
        query = deltas.run(spark.readStream.schema(schema).parquet(f"{path}/in"), path, f"{path}/ck", "6h", [metric], ["id"], order="seq", deleted="gone", trigger={"availableNow": True})
        query.awaitTermination()
        assert query.recentProgress and all(not p["stateOperators"] for p in query.recentProgress)
    assert deltas.current_bins(spark, path, [metric]).agg(F.count("*"), F.sum("v_n"), F.sum("v_sum")).first() == (2_000, 2_000, 3_500.0)
    assert deltas.table(spark, path, [metric]).read().where("batch = 1").count() == 500


def test_deltas_of_batches_sent_again_and_of_forgotten_readings(spark, tmp_path):
    path, schema = str(tmp_path / "d"), "device_id long, timestamp timestamp, id long, v double, seq int, gone boolean"
    metric, t, at = Metric("v", "v", scale=1), 1_704_067_200_000, datetime(2024, 1, 1)
    send = lambda i, *rows, **k: deltas.add(spark.createDataFrame([(1, at, *r) for r in rows], schema), i, path, "6h", [metric], ["id"], "timestamp", "seq", "gone", **k)
    held = lambda: [tuple(r)[1:] for r in deltas.current_bins(spark, path, [metric]).collect()]
    first, second = [(1, 1.0, 0, False), (2, 2.0, 0, False), (None, 4.0, 0, False)], [(1, 5.0, 0, False), (2, 9.0, None, True), (2, 8.0, 7, False), (None, 6.0, 1, False)]
    for _ in range(2):
        send(0, *first)
    assert held() == [(t, 3, 7.0, 21.0)]
    for _ in range(2):
        send(1, *second)  # a null order is last
    assert held() == [(t, 2, 11.0, 61.0)]
    deltas.fold(spark, path, [metric], 1)
    assert held() == [(t, 2, 11.0, 61.0)] and deltas.moved(spark, path, [metric]).read().count() == 2
    send(2, (1, 1.0, 0, False), (1, 1.0, 1, True), (1, 7.0, 2, False), (1, 8.0, 3, False), (None, 1.0, 0, False), replace=False)  # held, taken away, and the first after that stays
    assert held() == [(t, 2, 13.0, 85.0)]
    send(3, (1, 2.0, 0, False), ttl_ms=0)  # what was held is forgotten: nothing is taken off
    assert held() == [(t, 3, 15.0, 89.0)]


def test_rolling_over_odd_values(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 60_000, None), (1, 120_000, 3.0), (1, 10_000_000, None)], "device_id long, ms long, v double")
    out = {r["ms"]: (r["mean"], r["stddev"]) for r in analytics.rolling(df, 4, "v").collect()}
    assert out == {0: (2.0, 1.0), 60_000: (2.0, 1.0), 120_000: (2.0, 1.0), 10_000_000: (None, 0.0)}
    same = {r["ms"]: (r["mean"], r["stddev"]) for r in analytics.rolling(df, 1, "v").collect()}
    assert same == {0: (1.0, 0.0), 60_000: (None, 0.0), 120_000: (3.0, 0.0), 10_000_000: (None, 0.0)}


def test_rows_are_not_held_against_each_entry(spark):
    """40,000 shards of one day and as many entries on it that none precedes: a row costs one look-up, not one an entry."""
    day, n = 86_400_000, 40_000
    shards = spark.range(n).selectExpr("id as device_id", "'raw' as tier", "'1d' as rung", "0L as period_start", f"{day}L as period_end", "id as written_at")
    journal = spark.range(n).selectExpr("id % 7 as start", f"{day} - id % 5 as end", f"if(id = 5, {n - 2}L, -id) as requested_at")
    found = registry.stale(shards, journal)
    assert sorted(r["device_id"] for r in found.collect()) == list(range(n - 2)) and found.columns == shards.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and registry.prune_journal(journal, shards).count() == 1
    with pytest.raises(ValueError):
        joins.overlapping(shards, journal, ["device_id"], day, F.lit(True))


def test_spans_of_any_length_meet(spark):
    random = __import__("random").Random(4)
    spans = [(s := random.randrange(-3000, 3000), s + random.choice([0, 1, 7, 90, 900, 4000])) for _ in range(150)]
    others = [(s := random.randrange(-3000, 3000), s + random.choice([1, 5, 70, 2500])) for _ in range(25)]
    left = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, start long, end long")
    right = spark.createDataFrame(others, "r_start long, r_end long")
    for width in (1, 10, 1000):
        found = {r["i"] for r in joins.overlapping(left, right, ["i"], width).collect()}
        assert found == {i for i, (s, e) in enumerate(spans) if s < e and any(s < b and e > a for a, b in others)}
    day, own = 86_400_000, spark.createDataFrame([(s * 86_400_000 + 5,) for s in (-700, 0, 1, 300, 511, 512, 777)], "s long")
    a, b = joins.blocks(F.col("s"), F.col("s") + 512 * day, day)
    assert max(r[0] for r in own.select(F.size(a) + F.size(b)).collect()) <= 40


def test_fleet_plans_equal_each_devices_own(spark):
    random = __import__("random").Random(9)
    p, hour = default_pyramid([{"name": "v"}]), 3_600_000
    rungs = {t.name: [str(r) for r in t.shards] for t in p.tiers}
    shards = []
    for d in range(12):
        for _ in range(random.randrange(0, 25)):
            t = random.choice(["raw", "m10", "h2", "d1"])
            s = random.randrange(-10, 200) * hour
            shards.append((d, t, random.choice(rungs[t]), s, s + random.choice([hour // 7, hour, 5 * hour, 50 * hour])))
    table = spark.createDataFrame(shards, "device_id long, tier string, rung string, period_start long, period_end long")
    for budget in (8, 90, 900):
        plan, segments = q.plan_fleet(p, table, 3 * hour, 180 * hour, budget)
        got: dict = {}
        for r in segments.orderBy("device_id", "start").collect():
            got.setdefault(r["device_id"], []).append((r["tier"], r["start"], r["end"]))
        for d in range(12):
            one = q.plan_from_inventory(p, 3 * hour, 180 * hour, budget, [s[1:] for s in shards if s[0] == d])
            assert (one.output_tier, one.output_bin) == (plan.output_tier, plan.output_bin)
            assert got.get(d, []) == [(s.tier, s.start, s.end) for s in one.segments]


def test_a_restarted_source_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(rest.ReadingsSource)
    hour = 3_600_000
    options = {"pages": "tests.pages:fetch", "devices": "1,2,3", "from": 0, "until": 4 * hour, "slice_hours": 1, "limit": 25, "max_requests": 8, "requests_a_slice": 4, "progress": str(tmp_path / "progress.json")}
    batches: list = []

    def each(df, i):
        rows = [(r["device_id"], int(r["timestamp"].timestamp() * 1000)) for r in df.collect()]
        if len(batches) == 2 and not getattr(each, "failed", False):
            each.failed = True
            raise RuntimeError("stopped within a batch")
        batches.append((i, rows))

    def go(seconds):
        q = spark.readStream.format("readings").options(**options).load().writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(seconds * 5):
                q.awaitTermination(0.2)
                if sum(len(r) for _, r in batches) >= 720 or not q.isActive:
                    break
        except Exception as e:
            assert "stopped within a batch" in str(e)
        finally:
            q.stop()

    for _ in range(6):
        go(20)
    rows = [r for _, own in batches for r in own]
    assert len(rows) == len(set(rows)) == 3 * 240 and each.failed
    assert {d for d, _ in rows} == {1, 2, 3} and max(len({d for d, _ in own}) for _, own in batches) <= 2  # two slices a batch


def test_a_silent_device_raises_its_alerts(spark, tmp_path):
    now, minute = int(time.time() * 1000), 60_000
    spark.createDataFrame([(1, now - 20 * minute), (2, now)], "device_id long, ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("device_id long, ms long").parquet(str(tmp_path / "in"))
    with deltas.with_rocks(spark):
        query = staleness.watch(source, every_ms=1_500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    read = lambda: spark.read.schema(f"{staleness.SCHEMA}, last_at long").parquet(str(tmp_path / "out"))
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if (tmp_path / "out").exists() and read().where("device_id = 1").count() >= 4:
                break
    finally:
        query.stop()
    rows = read().orderBy("device_id", "checked_at").collect()
    silent = [(r["status"], r["level"]) for r in rows if r["device_id"] == 1]
    assert silent[:3] == [("alerted", 5), ("alerted", 15), ("below-level", 15)] and len(silent) >= 4  # one check has readings, the others timers
    assert {r["status"] for r in rows if r["device_id"] == 2} == {"fresh"}
    same = staleness.alerts(read().select("device_id", "checked_at", "last_at"))
    columns = ["device_id", "checked_at", "status", "stale_minutes", "level", "first_stale_at"]
    assert sorted(map(tuple, same.select(columns).collect())) == sorted(map(tuple, read().select(columns).collect()))


def test_expected_slots_equal_the_greedy_cover(spark):
    random, day = __import__("random").Random(1), 86_400_000
    now = 1_718_409_600_000 + 12_345_678
    genesis = [now - random.randrange(-2 * day, 900 * day) for _ in range(40)] + [now - 512 * day, now - day // 2, now, now + 5, 0, -40 * day]
    devices = spark.createDataFrame(list(enumerate(genesis)), "device_id long, genesis long")
    for ladder in (["1d"], ["4d", "32d", "128d"], ["1d", "1mo"], ["1mo", "3mo", "1y"]):
        got: dict = {}
        for r in registry.expected(devices, {"t": ladder}, now).drop("tier").collect():
            got.setdefault(r[0], []).append(tuple(r)[1:])
        for i, g in enumerate(genesis):
            assert sorted(got.get(i, [])) == sorted((s.rung, s.start, s.end, s.effective_start, s.effective_end, s.label) for s in min_cover([Duration.of(x) for x in ladder], g, now))


def test_no_tier_is_taken_up_within_a_bin():
    p, hour = default_pyramid([{"name": "v"}]), 3_600_000
    shards = [("raw", "1d", 0, 10 * hour), ("d1", "32d", 0, 96 * hour), ("raw", "1d", 10 * hour, 20 * hour)]
    plan = q.plan_from_inventory(p, 0, 96 * hour, 4, [s for s in shards if s[0] == "raw"] + [("d1", "32d", 5 * hour, 96 * hour)])
    assert [(s.tier, s.start, s.end) for s in plan.segments] == [("raw", 0, 20 * hour), ("d1", 24 * hour, 96 * hour)]
    assert [(s.tier, s.start, s.end) for s in q.plan_from_inventory(p, 0, 96 * hour, 4, shards).segments] == [("d1", 0, 96 * hour)]


def test_a_merge_tells_its_conflicts(spark, tmp_path):
    schema = "k int, v double"
    old, new = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], schema), spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, 4.0)], schema)
    seen = Observation()
    assert sorted(tuple(r) for r in ingest.merge(old, new, ["k"], ["v"], seen=seen).collect()) == [(1, 1.0), (2, None), (3, 3.0), (4, 4.0)]
    assert seen.get == {"rows": 4, "conflicts": 2}
    merge = lambda v, how="warn": files.merge_monthly(spark, str(tmp_path / "m"), spark.createDataFrame([(datetime(2024, 1, 1), v)], "timestamp timestamp, v double"), ["timestamp"], ["v"], on_conflict=how)
    assert merge(1.0)
    with pytest.warns(UserWarning, match="1 keys have readings that differ"):
        assert not merge(2.0)
    assert merge(2.0, "replace")


def test_bands_of_null_spreads(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 5.0, 1.0), (2, None, None), (3, -1.0, None)], "k int, m double, s double")
    bounds = lambda **a: {r["k"]: (r["y_min"], r["y_max"]) for r in analytics.axis_bounds(df, F.col("m"), F.col("s"), ["k"], **a).collect()}
    assert bounds() == {1: (pytest.approx(1.8), pytest.approx(6.2)), 3: (-1.0, 0.0)}
    assert bounds(auto=False) == {1: (0.0, 6.0), 3: (-1.0, 0.0)}


def test_table_places():
    assert analytics.first_index(10 * 60_000, None, 60_000) == 1
    assert [analytics.first_index(600_000, e, 60_000) for e in (600_000, 540_000, 569_999, 900_000)] == [1, 2, 2, 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "device_id long, ms long")
    assert series.gaps(empty).count() == 0 and analytics.input_bin_width(empty).count() == 0

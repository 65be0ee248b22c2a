"""Building and rebuilding a stored pyramid.

Each tier is written once and the coarser ones read it back, so a fleet's backfill is one
job a tier and no tier is computed twice. A rebuild widens the spans it is told of to the
bins of each tier and to the stored partitions these begin in, and replaces those and no
others: what had bins and has none goes. Every write is a version of its tier
(``sources.commits``), so a reader sees all of it or nothing, and it can be repeated after
a failure.

``converge`` goes by dependency: a slot's inputs are the periods of its source that the
registry holds, only slots with all inputs enter the registry, and a group of devices whose
tier fails is held back from the coarser tiers while the others go on.
"""

from __future__ import annotations

import time as clock
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.durations import Duration
from ..functions.timeaxis import bins_between, ceil_bin, floor_bin, parse_period, period_starts, periods_overlapping, span_of
from ..operators import registry
from ..operators.ingest import in_range
from ..operators.rollup import TS, aggregate_raw, coarsen
from ..sources.commits import Versioned
from ..sources.files import BUCKETS, bucket_of, parts_between, read_tier, tier_schema, write_tier
from .pyramid import Pyramid, Tier

FIRST, LAST = -(1 << 45), 1 << 45


def _bins_from(tier: Tier, start: int, end: int) -> tuple[int, int]:
    """The span of the bins that begin in [start, end)."""
    return ceil_bin(start, tier.bin), ceil_bin(end, tier.bin)


def _built(pyramid: Pyramid, tier: Tier, readings: DataFrame, base: str, start: int, end: int, time: str) -> DataFrame:
    metrics, dims = list(pyramid.metrics), list(pyramid.dims)
    source = pyramid.source_of(tier.name)
    if source is None:
        return aggregate_raw(in_range(readings, time, start, end), str(tier.bin), metrics, dims, time)
    held = read_tier(readings.sparkSession, base, source, metrics, start, end)
    return coarsen(held, str(source.bin), str(tier.bin), metrics, dims)


def backfill(pyramid: Pyramid, readings: DataFrame, base: str, time: str = "timestamp", start: int = FIRST, end: int = LAST) -> None:
    """Write every tier's bins that begin in the partitions that [start, end) meets, under ``base``."""
    for tier in pyramid.ordered:
        lo, hi = span_of(start, tier.part)[0], ceil_bin(end, tier.part)
        write_tier(_built(pyramid, tier, readings, base, *_bins_from(tier, lo, hi), time), base, tier, replaced=parts_between(tier, lo, hi))


def touched_parts(tier: Tier, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of stored partitions in which the tier's bins begin that the spans meet."""
    runs: list[list[int]] = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        lo, hi = span_of(span_of(s, tier.bin)[0], tier.part)[0], ceil_bin(ceil_bin(e, tier.bin), tier.part)
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(hi, runs[-1][1])
        else:
            runs.append([lo, hi])
    return [(a, b) for a, b in runs]


def rebuild_tier(pyramid: Pyramid, tier: Tier, readings: DataFrame, base: str, spans: list[tuple[int, int]], time: str = "timestamp", buckets: list[int] | None = None) -> int:
    """Rebuild the tier's bins that the spans touch, of some groups of devices or of all; how many partitions were replaced."""
    replaced = 0
    for start, end in touched_parts(tier, spans):
        state, own = _built(pyramid, tier, readings, base, *_bins_from(tier, start, end), time), parts_between(tier, start, end)
        if buckets is not None:
            state, own = state.where(bucket_of().isin(buckets)), own & F.col("bucket").isin(buckets)
        write_tier(state, base, tier, replaced=own)
        replaced += bins_between(start, end, tier.part)
    return replaced


def rebuild(pyramid: Pyramid, readings: DataFrame, base: str, journal: list[tuple[int, int]], time: str = "timestamp") -> None:
    """Rebuild every tier's bins that the journal's spans touch, fine tiers first."""
    for t in pyramid.ordered:
        rebuild_tier(pyramid, t, readings, base, journal, time)


def tier(pyramid: Pyramid, spark: SparkSession, base: str, name: str, start: int = FIRST, end: int = LAST) -> DataFrame:
    t = pyramid.tier(name)
    return read_tier(spark, base, t, list(pyramid.metrics), start, end).select(*pyramid.dims, TS, *(F.col(s) for m in pyramid.metrics for s in m.state))


@dataclass(frozen=True)
class Built:
    """What became of one shard: ``written``, or ``no_inputs`` and nothing written; periods of the source that have rows, and all of them."""

    status: str
    inputs_present: int
    inputs_expected: int


def build_shard(pyramid: Pyramid, readings: DataFrame, base: str, name: str, shard: str, label: str, time: str = "timestamp") -> Built:
    """Build the bins of one period of a tier from its source, as far as that is there."""
    t = pyramid.tier(name)
    if Duration.of(shard) not in t.shards:
        raise ValueError(f"tier {name} has no shards of {shard}")
    start, end = parse_period(label, shard)
    source = pyramid.source_of(name)
    step = Duration.of("1d") if source is None else source.tip
    if source is None:
        rows = in_range(readings, time, start, end).select(F.unix_millis(F.col(time).cast("timestamp")).alias(TS))
    else:
        rows = read_tier(readings.sparkSession, base, source, list(pyramid.metrics), start, end)
    present = rows.select(floor_bin(F.col(TS), step).alias("period")).distinct().count()
    expected = len(periods_overlapping(start, end, step))
    if present:
        rebuild_tier(pyramid, t, readings, base, [(start, end)], time)
    return Built("written" if present else "no_inputs", present, expected)


# Shards by rung ----------------------------------------------------------------------------


def shard_table(spark: SparkSession, base: str, name: str, schema: StructType) -> Versioned:
    """A tier's shards: by rung, period and group of devices."""
    more = StructType([StructField("rung", StringType())]).add("period_start", "long").add("bucket", "integer")
    return Versioned(spark, f"{base}/shards/tier={name}", StructType([*schema, *more]), ("rung", "period_start", "bucket"))


def write_shards(state: DataFrame, base: str, name: str, rung: str, buckets: int = BUCKETS, expected: int | None = None) -> int:
    """A tier's rows as files by rung, period and group of devices, sorted by device and time; the table's version.

    A write replaces the periods of the devices it holds; other devices' rows stay. One that
    was made from another version than ``expected``, or whose files another writer changed
    meanwhile, raises StaleVersion.
    """
    rows = state.withColumns({"rung": F.lit(rung), "period_start": floor_bin(F.col(TS), rung), "bucket": bucket_of(buckets=buckets)})
    dealt = rows.repartition("period_start", "bucket").sortWithinPartitions("period_start", "bucket", "device_id", TS)
    return shard_table(state.sparkSession, base, name, state.schema).commit(dealt, keys=["rung", "period_start", "device_id"], expected=expected)


def read_shards(spark: SparkSession, pyramid: Pyramid, base: str, name: str, rung: str) -> DataFrame:
    """Rows of all shards of a rung, with their period_start."""
    rows = shard_table(spark, base, name, tier_schema(list(pyramid.metrics))).read()
    return rows.where(F.col("rung") == rung).drop("rung", "bucket")


def consolidate(pyramid: Pyramid, base: str, recorded: DataFrame, name: str, source_rung: str, target_rung: str, now: int) -> DataFrame:
    """Write the closed target periods that shards of the source rung tile without a hole; the registry rows of these.

    A device's period with a hole is left alone.
    """
    spark = recorded.sparkSession
    whole = registry.record_complete(registry.consolidation(recorded, name, source_rung, target_rung, now))
    rows = read_shards(spark, pyramid, base, name, source_rung).withColumn("period_start", floor_bin(F.col("period_start"), target_rung))
    kept = rows.join(whole.select("device_id", "period_start"), ["device_id", "period_start"], "left_semi")
    write_shards(kept.drop("period_start"), base, name, target_rung)
    return whole.select("device_id", "tier", "rung", "period_start", "period_end", F.lit(now).cast("long").alias("written_at"))


# Convergence -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Converged:
    """``results``: (tier, status, partitions) each; ``registry``: its rows after the run; ``slots``: what became of each slot that was due."""

    results: list[tuple[str, str, int]]
    registry: DataFrame
    slots: DataFrame


def inputs(pyramid: Pyramid, t: Tier, todo: DataFrame, recorded: DataFrame, readings: DataFrame, time: str) -> DataFrame:
    """``todo`` with inputs_present and inputs_expected: periods of the source's shortest rung in the slot's effective range that recorded shards cover, and all of them.

    The finest tier's inputs are days with readings. One join on device and period for all slots, which are found once.
    """
    source = pyramid.source_of(t.name)
    if source is None:
        step = Duration.of("1d")
        held = readings.select("device_id", floor_bin(F.unix_millis(F.col(time).cast("timestamp")), step).alias("_input")).distinct()
    else:
        step = source.tip
        own = recorded.where(F.col("tier") == source.name)
        held = own.select("device_id", F.explode(period_starts(F.col("period_start"), F.col("period_end"), step)).alias("_input")).distinct()
    slots = todo.withColumn("_inputs", period_starts(F.col("effective_start"), F.col("effective_end"), step)).withColumn("inputs_expected", F.size("_inputs").cast("long"))
    wanted = slots.withColumn("_input", F.explode_outer("_inputs")).drop("_inputs")
    found = wanted.join(held.withColumn("_have", F.lit(1)), ["device_id", "_input"], "left")
    return found.groupBy(*todo.columns, "inputs_expected").agg(F.count("_have").alias("inputs_present"))


def converge(pyramid: Pyramid, devices: DataFrame, recorded: DataFrame, journal: DataFrame, readings: DataFrame, base: str, now: int, budget_s: float = 25.0, tiers: list[str] | None = None, time: str = "timestamp", dry_run: bool = False) -> Converged:
    """Build what is missing or stale, a tier at a time for all devices, fine tiers first.

    Of the slots that are due, those with no inputs get nothing (``no_inputs``), those with
    some are built as far as these go (``partial``), and those with all are built and
    recorded (``written``). If a tier fails, its devices are halved by group until the failing
    groups stand alone (``failed``); coarser tiers leave these groups alone (``held``).
    With under half a second of the budget left no further write begins (``skipped``).
    ``dry_run`` writes nothing, takes no slot as built, and calls what it would build ``due``.
    What was found due and the registry after each tier are kept under ``base``/_runs, so that
    no step finds again what those before it did; distinct periods reach the driver.
    """
    began, spark = clock.monotonic(), readings.sparkSession
    run, results, after, outcomes = uuid.uuid4().hex, [], recorded, []
    bad: set[int] = set()
    late = lambda: clock.monotonic() - began > budget_s - 0.5
    for t in pyramid.ordered:
        if tiers is not None and t.name not in tiers:
            continue
        if late():
            results.append((t.name, "skipped", 0))
            continue
        ladder = {t.name: [str(r) for r in t.shards]}
        todo = registry.work(registry.expected(devices, ladder, now), after.where(F.col("tier") == t.name), journal, [t.name])
        due, at = inputs(pyramid, t, todo, after, readings, time).withColumn("bucket", bucket_of()), f"{base}/_runs/{run}/tier={t.name}"
        due.write.parquet(at)
        due = spark.read.schema(due.schema).parquet(at)
        ready = due.where("inputs_present > 0")
        spans: dict[int, set[tuple[int, int]]] = {}
        for r in ready.groupBy("bucket", "period_start", "period_end").agg(F.min("effective_start").alias("s"), F.max("effective_end").alias("e")).collect():
            spans.setdefault(r["bucket"], set()).add((r["s"], r["e"]))
        parts, failed, skipped = 0, {}, set()

        def attempt(buckets: list[int]) -> int:
            if late():
                skipped.update(buckets)
                return 0
            try:
                return rebuild_tier(pyramid, t, readings, base, sorted(set().union(*(spans[b] for b in buckets))), time, buckets)
            except Exception as e:  # one group's failure is no other's
                if len(buckets) == 1:
                    failed[buckets[0]] = type(e).__name__
                    return 0
                half = len(buckets) // 2
                return attempt(buckets[:half]) + attempt(buckets[half:])

        groups = sorted(spans.keys() - bad)
        if groups and not dry_run:
            parts = attempt(groups)
        among = lambda b: F.col("bucket").isin(sorted(b)) if b else F.lit(False)
        built = F.when(F.col("inputs_present") == F.col("inputs_expected"), "written").otherwise("partial")
        status = F.when(among(bad), "held").when(F.col("inputs_present") == 0, "no_inputs").when(among(failed.keys()), "failed").when(among(skipped), "skipped").when(F.lit(dry_run), "due").otherwise(built)
        told = due.withColumn("status", status).drop("bucket")
        outcomes.append(told)
        after = registry.upsert(after, told.where("status = 'written'").select(*registry.KEY, "period_end", F.lit(now).cast("long").alias("written_at")))
        if not dry_run:
            kept = f"{base}/_runs/{run}/registry={t.name}"
            after.write.parquet(kept)
            after = spark.read.schema(after.schema).parquet(kept)
        bad |= failed.keys()
        errors = ", ".join(sorted(set(failed.values())))
        results.append((t.name, f"failed: {errors}" if failed and not parts else f"written, {len(failed)} of {len(groups)} groups failed: {errors}" if failed else "skipped" if skipped else "due" if dry_run else "written", parts))
    slots = outcomes[0].sparkSession.createDataFrame([], outcomes[0].schema) if outcomes else None
    for told in outcomes:
        slots = slots.unionByName(told)
    if slots is None:
        slots = registry.work(registry.expected(devices, {}, now), recorded, journal, [""]).withColumns({"inputs_expected": F.lit(0).cast("long"), "inputs_present": F.lit(0).cast("long"), "status": F.lit("skipped")})
    return Converged(results, after, slots)


def backfill_missing(pyramid: Pyramid, devices: DataFrame, recorded: DataFrame, readings: DataFrame, base: str, now: int, force: bool = False, tiers: list[str] | None = None, time: str = "timestamp", dry_run: bool = False) -> Converged:
    """Every tier's covering periods of every device, without those recorded unless ``force``d; failures are in ``slots``, and others' work goes on."""
    held = recorded.limit(0) if force else recorded
    nothing = readings.sparkSession.createDataFrame([], "start long, end long, requested_at long")
    return converge(pyramid, devices, held, nothing, readings, base, now, float("inf"), tiers, time, dry_run)

"""The shard registry: what should exist, what does, what is stale, how far it reaches.

Registry rows: device_id, tier, rung, period_start, period_end (ms), key, written_at and
optional size_bytes, n_rows, n_rgs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import Duration
from ..functions.timeaxis import bin_end, floor_bin, period_label, period_starts, span_of
from .joins import overlapping, uncovered_days

KEY = ["device_id", "tier", "rung", "period_start"]
SLOT_SCHEMA = "device_id long, tier string, rung string, period_start long, period_end long, effective_start long, effective_end long, label string"


def _placed(place, d: Duration):
    return lambda start: place(d, start, bin_end(start, d), start)


def expected(devices: DataFrame, tiers: dict[str, list[str]], now: int) -> DataFrame:
    """The slots each device (device_id, genesis) should have in each tier (name: ladder of rungs): ``plans.cover.min_cover`` as columns.

    The first slot is the longest closed period that holds the genesis. What follows it is
    covered by the longest rung's whole periods up to now, and before and after these by
    those of the next shorter rung, and so on: a rung divides the next one.
    """
    known = devices.where("genesis is not null").select(F.col("device_id").cast("long").alias("device_id"), F.col("genesis").cast("long").alias("genesis"))
    out = None
    for tier, rungs in tiers.items():
        ladder = [Duration.of(r) for r in rungs]
        starts = [floor_bin(F.col("genesis"), d) for d in ladder]
        place = lambda d, start, end, since: F.struct(F.lit(str(d)).alias("rung"), start.alias("period_start"), end.alias("period_end"), since.alias("effective_start"))
        closed = [F.when(bin_end(s, d) <= now, place(d, s, bin_end(s, d), F.greatest(s, F.col("genesis")))) for d, s in zip(ladder, starts)]
        begun = known.where(F.col("genesis") < now).withColumn("_first", F.coalesce(*reversed(closed))).where("_first is not null").withColumn("_at", F.col("_first.period_end"))
        lo = [F.when(floor_bin(F.col("_at"), d) == F.col("_at"), F.col("_at")).otherwise(bin_end(floor_bin(F.col("_at"), d), d)) for d in ladder]
        hi = [F.lit(span_of(now, d)[0]).cast("long") for d in ladder]
        slots = [F.array("_first")]
        for i, d in enumerate(ladder):
            longer = i + 1 < len(ladder)
            above = lo[i + 1] < hi[i + 1] if longer else F.lit(False)
            spans = [(lo[i], F.when(above, lo[i + 1]).otherwise(hi[i]) if longer else hi[i])]
            if longer:
                spans.append((F.when(above, hi[i + 1]).otherwise(hi[i]), hi[i]))
            slots += [F.transform(period_starts(s, e, d), _placed(place, d)) for s, e in spans]
        rows = begun.select("device_id", F.lit(tier).alias("tier"), F.explode(F.concat(*slots)).alias("s")).select("device_id", "tier", "s.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return known.sparkSession.createDataFrame([], SLOT_SCHEMA)
    label = F.coalesce(*(F.when(F.col("rung") == str(d), period_label(F.col("period_start"), d.unit)) for d in {Duration.of(r) for rungs in tiers.values() for r in rungs}))
    return out.withColumn("effective_end", F.col("period_end")).withColumn("label", label).select(*(c.split()[0] for c in SLOT_SCHEMA.split(", ")))


def missing(expected_: DataFrame, recorded: DataFrame) -> DataFrame:
    return expected_.join(recorded.select(*KEY), KEY, "left_anti")


def stale(recorded: DataFrame, journal: DataFrame, width: int = 86_400_000) -> DataFrame:
    """Recorded shards that a journal entry (start, end, requested_at; ms) overlaps and postdates."""
    entries = journal.select(F.col("start").alias("r_start"), F.col("end").alias("r_end"), "requested_at")
    return overlapping(recorded, entries, KEY, width, F.col("written_at") < F.col("_best"), ("period_start", "period_end"), best=(F.max, "requested_at"))


def work(expected_: DataFrame, recorded: DataFrame, journal: DataFrame, tier_order: list[str], tip: tuple[str, str] | None = None) -> DataFrame:
    """Missing and stale slots in the order to build them: finer tiers, shorter rungs, older periods first; the tip's rung is not ours to build."""
    again = stale(recorded, journal).select(*KEY)
    todo = missing(expected_, recorded).unionByName(expected_.join(again, KEY, "left_semi")).distinct()
    if tip is not None:
        todo = todo.where(~((F.col("tier") == tip[0]) & (F.col("rung") == tip[1])))
    place = F.array_position(F.array(*map(F.lit, tier_order)), F.col("tier"))
    return todo.orderBy(place, F.col("period_end") - F.col("period_start"), "period_start", "device_id")


def prune_journal(journal: DataFrame, recorded: DataFrame, width: int = 86_400_000) -> DataFrame:
    """Entries that some recorded shard still has to follow."""
    spans = recorded.select(F.col("period_start").alias("r_start"), F.col("period_end").alias("r_end"), "written_at")
    return overlapping(journal, spans, ["start", "end", "requested_at"], width, F.col("_best") < F.col("requested_at"), best=(F.min, "written_at"))


def upsert_watermarks(held: DataFrame, new: DataFrame) -> DataFrame:
    """One row a device, tier and rung: the latest end of both sides, a mark never moves back; the latest update."""
    both = held.unionByName(new)
    return both.groupBy("device_id", "tier", "rung").agg(F.max("latest_period_end").alias("latest_period_end"), F.max("updated_at").alias("updated_at"))


def shards_overlapping(recorded: DataFrame, targets: DataFrame, width: int = 86_400_000) -> DataFrame:
    """Recorded shards whose period meets a target's effective range (effective_start, effective_end)."""
    spans = targets.select(F.col("effective_start").alias("r_start"), F.col("effective_end").alias("r_end"))
    return overlapping(recorded, spans, KEY, width, None, ("period_start", "period_end"))


def upsert(recorded: DataFrame, new: DataFrame) -> DataFrame:
    """One row a key, the latest written; state a new row lacks (nulls) comes from the old one."""
    rest = [c for c in recorded.columns if c not in KEY]
    both = recorded.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_new", "written_at")
    return both.groupBy(*KEY).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest)).select(*recorded.columns)


def record_complete(built: DataFrame) -> DataFrame:
    """Built shards (inputs_present, inputs_expected) fit for the registry: all inputs were there."""
    return built.where("inputs_present = inputs_expected and inputs_expected > 0")


def watermarks(recorded: DataFrame) -> DataFrame:
    """Per device, tier and rung the latest period_end, and when that row was written."""
    latest = F.struct("period_end", "written_at")
    return recorded.groupBy("device_id", "tier", "rung").agg(F.max("period_end").alias("latest_period_end"), F.max(latest)["written_at"].alias("updated_at"))


def raw_tips(recorded: DataFrame, devices: DataFrame, now: int) -> DataFrame:
    """Closed rows of the registry and, for days of a device (device_id, start, end) no row covers, a synthetic one-day row."""
    closed = recorded.where(F.col("period_end") <= now).select("device_id", "rung", "period_start", "period_end")
    spans = closed.select("device_id", F.col("period_start").alias("r_start"), F.col("period_end").alias("r_end"))
    days = uncovered_days(devices, spans).select("device_id", F.lit("1d").alias("rung"), F.col("day").alias("period_start"), (F.col("day") + 86_400_000).alias("period_end"))
    return closed.unionByName(days)


def rung_stats(recorded: DataFrame) -> DataFrame:
    """Shards, last write, and null-skipping means of size, rows, row groups and of each shard's rows a row group."""
    ratio = F.when(F.col("n_rgs") > 0, F.col("n_rows") / F.col("n_rgs"))
    return recorded.groupBy("device_id", "tier", "rung").agg(F.count("*").alias("shards"), F.max("written_at").alias("last_written"), F.avg("size_bytes").alias("mean_bytes"), F.avg("n_rows").alias("mean_rows"), F.avg("n_rgs").alias("mean_rgs"), F.avg(ratio).alias("mean_rows_a_rg"))


def slots(expected_: DataFrame, recorded: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Expected slots with status: present when recorded; pending when ``sources`` (KEY) says its inputs are there; else missing."""
    out = expected_.join(recorded.select(*KEY, F.lit(True).alias("_have")), KEY, "left")
    if sources is not None:
        out = out.join(sources.select(*KEY).distinct().withColumn("_ready", F.lit(True)), KEY, "left")
    else:
        out = out.withColumn("_ready", F.lit(None).cast("boolean"))
    status = F.when(F.col("_have"), "present").when(F.col("_ready"), "pending").otherwise("missing")
    return out.withColumn("status", status).drop("_have", "_ready")


def coverage(slots_: DataFrame, stale_: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """Per device and tier: expected, present, pending, the first missing period and whether none is missing.

    With the stale shards (KEY) also how many they are; with ``now`` the seconds since the
    end of the last expected period (the dust that no closed period covers yet).
    """
    gone = F.col("status") == "missing"
    out = slots_.groupBy("device_id", "tier").agg(
        F.count("*").alias("expected"), F.count_if(F.col("status") == "present").alias("present"), F.count_if(F.col("status") == "pending").alias("pending"), F.min(F.when(gone, F.col("period_start"))).alias("first_missing"), (F.count_if(gone) == 0).alias("complete"), F.max("period_end").alias("_end")
    )
    if stale_ is not None:
        counts = stale_.groupBy("device_id", "tier").agg(F.count("*").alias("stale"))
        out = out.join(counts, ["device_id", "tier"], "left").withColumn("stale", F.coalesce("stale", F.lit(0).cast("long")))
    if now is not None:
        out = out.withColumn("dust_age_s", F.floor((F.lit(now) - F.col("_end")) / 1000))
    return out.drop("_end")


def coverage_levels(slots_: DataFrame) -> DataFrame:
    """Rungs, tiers and devices in one pass: level, device_id, tier and rung (null above their level), expected, present, pending, missing, first missing period, and whether none is."""
    gone = F.col("status") == "missing"
    levels = slots_.groupingSets([["device_id", "tier", "rung"], ["device_id", "tier"], ["device_id"]], "device_id", "tier", "rung")
    out = levels.agg(
        F.grouping_id().alias("_set"), F.count("*").alias("expected"), F.count_if(F.col("status") == "present").alias("present"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(gone).alias("missing"), F.min(F.when(gone, F.col("period_start"))).alias("first_missing")
    )
    level = F.when(F.col("_set") == 0, "rung").when(F.col("_set") == 1, "tier").otherwise("device")
    return out.select(level.alias("level"), "device_id", "tier", "rung", "expected", "present", "pending", "missing", "first_missing", (F.col("missing") == 0).alias("complete"))


def device_coverage(coverage_: DataFrame) -> DataFrame:
    return coverage_.groupBy("device_id").agg(F.sum(F.col("expected") - F.col("present") - F.col("pending")).alias("missing"), F.sum("pending").alias("pending"), F.bool_and("complete").alias("all_complete"))


def work_statistics(results: DataFrame) -> DataFrame:
    return results.groupBy("device_id", "status").agg(F.count("*").alias("shards"))


def consolidation(recorded: DataFrame, tier: str, source_rung: str, target_rung: str, now: int) -> DataFrame:
    """Closed target periods with how many of their source shards there are, and how many it takes.

    Only where all are there may the target be written (``record_complete``).
    """
    source, target = Duration.of(source_rung), Duration.of(target_rung)
    if not source.divides(target):
        raise ValueError(f"{source} does not divide {target}")
    own = recorded.where((F.col("tier") == tier) & (F.col("rung") == source_rung)).withColumn("_start", floor_bin(F.col("period_start"), target))
    found = own.groupBy("device_id", "_start").agg(F.count_distinct("period_start").alias("inputs_present")).withColumn("period_end", bin_end(F.col("_start"), target)).where(F.col("period_end") <= now)
    expected_ = (F.col("period_end") - F.col("_start")) / F.lit(source.ms) if not source.is_calendar else F.months_between(F.timestamp_millis("period_end"), F.timestamp_millis("_start")) / (source.count * (12 if source.unit == "y" else 1))
    return found.select("device_id", F.lit(tier).alias("tier"), F.lit(target_rung).alias("rung"), F.col("_start").alias("period_start"), "period_end", "inputs_present", F.round(expected_).cast("long").alias("inputs_expected"))

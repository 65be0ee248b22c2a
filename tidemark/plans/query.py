"""Range queries over a pyramid: tier choice, splicing, smoothing.

Planning is driver code over a few tiers; the plan becomes one lazy DataFrame whose scans
carry the time and device filters, so partitions and row groups prune.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import Duration
from ..functions.timeaxis import bin_index, bins_between, ceil_bin, shift, span_of
from ..operators.rollup import TS, aggregate_raw, coarsen, stitch
from ..operators.series import moving_sums
from .pyramid import Pyramid


@dataclass(frozen=True)
class Smoothing:
    bins: int
    mode: str = "centered"

    @property
    def before(self) -> int:
        return self.bins // 2 if self.mode == "centered" else self.bins - 1

    @property
    def after(self) -> int:
        return self.bins // 2 if self.mode == "centered" else 0


@dataclass(frozen=True)
class Segment:
    tier: str
    start: int
    end: int
    reaggregate: bool


@dataclass(frozen=True)
class QueryPlan:
    output_tier: str
    output_bin: str
    authoritative_end: int
    segments: tuple[Segment, ...]
    smoothing: Smoothing | None = None


def choose_tier(pyramid: Pyramid, span: int, budget: int, start: int = 0) -> str:
    """The finest tier whose bins over [start, start + span) fit the budget, else the coarsest."""
    order = pyramid.ordered
    count = lambda t: bins_between(start, start + span, t.bin) if t.bin.is_calendar else -(-span // t.bin.ms)
    return next((t.name for t in order if count(t) <= budget), order[-1].name)


def smoothing_of(request: str | int | None, bin_: Duration, mode: str = "centered", auto: int = 50) -> Smoothing | None:
    """``auto`` (50 bins), ``autoK``, a duration, 0 (auto) or minutes; snapped to what the mode can show; None when off."""
    if request is None or request == 1 or request == "off":
        return None
    if request == 0 or request == "auto":
        bins = auto
    elif isinstance(request, str) and request.startswith("auto"):
        bins = int(request[4:])
    else:
        width = Duration.of(f"{request}min" if isinstance(request, int) else request).ms
        bins = max(1, round(width / bin_.usual_ms))
    if mode == "centered":
        bins = bins // 2 * 2 + 1
    return Smoothing(max(1, bins), mode)


def plan_query(pyramid: Pyramid, start: int, end: int, budget: int, fresh: dict[str, int], smooth: str | int | None = None, mode: str = "centered") -> QueryPlan:
    """Segments of the chosen tier and, past what each tier holds, of the nearest finer tier that divides it, down to the finest.

    ``fresh``: up to where each tier has data (ms); a tier without an entry holds the whole
    range. Bins that cross a cut come whole from finer tiers; a tier no fresher than those
    above it has no segment, and the finest tier has the rest. The scan widens by the
    smoothing's reach.
    """
    name = choose_tier(pyramid, end - start, budget, start)
    tier = pyramid.tier(name)
    smoothing = smoothing_of(smooth, tier.bin, mode)
    lo, hi = _reach(tier.bin, start, end, smoothing)
    finest = pyramid.ordered[0].name
    segments, at, now = [], lo, tier
    while now is not None and at < hi:
        source = pyramid.source_of(now.name)
        to = hi if source is None else min(hi, span_of(fresh.get(now.name, hi), now.bin)[0])
        if to > at:
            segments.append(Segment(now.name, at, to, now is not tier))
            at = to
        now = source
    return QueryPlan(name, str(tier.bin), fresh.get(finest, end), tuple(segments or [Segment(name, lo, hi, False)]), smoothing)


def _reach(bin_: Duration, start: int, end: int, smoothing: Smoothing | None) -> tuple[int, int]:
    """[start, end) widened to whole bins and by the smoothing's reach."""
    before, after = (smoothing.before, smoothing.after) if smoothing else (0, 0)
    return shift(span_of(start, bin_)[0], bin_, -before), shift(ceil_bin(end, bin_), bin_, after)


def plan_from_inventory(pyramid: Pyramid, start: int, end: int, budget: int, shards: list[tuple[str, str, int, int]], smooth: str | int | None = None, mode: str = "centered") -> QueryPlan:
    """Segments from the shards there are: (tier, rung, start, end) each.

    At each point the output tier's shard of the longest rung that covers it is taken,
    else the longest of the nearest finer tier that makes up its bins; where none covers
    it, the plan goes on at the next shard's start. A tier is taken up where a bin of its own
    begins, never within one, so no bin lacks a part of its readings.
    """
    name = choose_tier(pyramid, end - start, budget, start)
    tier = pyramid.tier(name)
    smoothing = smoothing_of(smooth, tier.bin, mode)
    lo, hi = _reach(tier.bin, start, end, smoothing)
    chain = [tier]
    while (source := pyramid.source_of(chain[-1].name)) is not None:
        chain.append(source)
    segments: list[Segment] = []
    at = lo
    while at < hi:
        wait = []
        for t in chain:
            if (whole := ceil_bin(at, t.bin)) != at:
                wait += [whole for n, _, s, e in shards if n == t.name and s <= at and span_of(e, t.bin)[0] > whole]
                continue
            # whole bins of the tier that the shard holds from here on
            held = [(min(hi, span_of(e, t.bin)[0]), Duration.of(r).usual_ms) for n, r, s, e in shards if n == t.name and s <= at < e]
            held = [h for h in held if h[0] > at]
            if held:
                to = max(held, key=lambda h: (h[1], h[0]))[0]
                last = segments[-1] if segments else None
                if last and last.tier == t.name and last.end == at:
                    segments[-1] = Segment(t.name, last.start, to, t is not tier)
                else:
                    segments.append(Segment(t.name, at, to, t is not tier))
                at = to
                break
        else:
            later = wait + [ceil_bin(s, t.bin) for t in chain for n, _, s, e in shards if n == t.name and s > at]
            at = min(later, default=hi)
    finest = chain[-1].name
    return QueryPlan(name, str(tier.bin), max((e for n, _, _, e in shards if n == finest), default=end), tuple(segments), smoothing)


SEGMENTS = "device_id long, tier string, start long, end long"


def plan_fleet(pyramid: Pyramid, shards: DataFrame, start: int, end: int, budget: int, smooth: str | int | None = None, mode: str = "centered") -> tuple[QueryPlan, DataFrame]:
    """``plan_from_inventory`` for every device by its own shards (device_id, tier, rung, period_start, period_end): the plan without segments, and these as rows (``SEGMENTS``).

    A device's shards stream through a task in order of their starts, so what it holds is the
    shards that cover one point.
    """
    name = choose_tier(pyramid, end - start, budget, start)
    tier = pyramid.tier(name)
    smoothing = smoothing_of(smooth, tier.bin, mode)
    lo, hi = _reach(tier.bin, start, end, smoothing)
    chain = [tier]
    while (source := pyramid.source_of(chain[-1].name)) is not None:
        chain.append(source)
    depth = {t.name: i for i, t in enumerate(chain)}
    near = shards.where(F.col("tier").isin(list(depth)) & (F.col("period_start") < hi) & (F.col("period_end") > lo)).select(F.col("device_id").cast("long"), "tier", "rung", F.col("period_start").cast("long"), F.col("period_end").cast("long"))

    def covered(held: Iterator[tuple[str, str, int, int]]) -> Iterator[tuple[str, int, int]]:
        """Runs (tier, start, end) of one device, its shards in order of their starts."""
        at, ahead, live, run = lo, deque(islice(held, 1)), [[] for _ in chain], None
        while at < hi:
            while ahead and ahead[0][2] <= at:
                name, rung, _, until = ahead.popleft()
                heapq.heappush(live[depth[name]], (-Duration.of(rung).usual_ms, -min(hi, span_of(until, chain[depth[name]].bin)[0])))
                if not ahead:
                    ahead.extend(islice(held, 1))
            for heap in live:
                while heap and -heap[0][1] <= at:
                    heapq.heappop(heap)
            whole = [ceil_bin(at, t.bin) for t in chain]
            place = next((i for i, heap in enumerate(live) if heap and whole[i] == at), None)
            if place is None:
                first = lambda s: ceil_bin(s[2], chain[depth[s[0]]].bin)
                wait = [w for w, heap in zip(whole, live) if any(-to > w for _, to in heap)]
                to, begun = min([*wait, *map(first, ahead)], default=hi), True
                while begun and ahead and ahead[-1][2] < to:  # a later one may begin on an earlier bin
                    begun = list(islice(held, 1))
                    ahead.extend(begun)
                    to = min([to, *map(first, begun)])
                at = to
                continue
            to = -live[place][0][1]
            if run is not None and (run[0], run[2]) == (chain[place].name, at):
                run = (run[0], run[1], to)
            else:
                if run is not None:
                    yield run
                run = (chain[place].name, at, to)
            at = to
        for _ in held:  # what begins later than the range
            pass
        if run is not None:
            yield run

    def cover(batches):
        rows = ((r[0], r[1:]) for pdf in batches for r in pdf.itertuples(index=False, name=None))
        out = [(device, *run) for device, own in groupby(rows, key=lambda r: r[0]) for run in covered(r[1] for r in own)]
        yield pd.DataFrame(out, columns=["device_id", "tier", "start", "end"])

    ordered = near.repartition("device_id").sortWithinPartitions("device_id", "period_start")
    return QueryPlan(name, str(tier.bin), end, (), smoothing), ordered.mapInPandas(cover, SEGMENTS)


def execute_fleet(plan: QueryPlan, segments: DataFrame, pyramid: Pyramid, tiers: dict[str, DataFrame], start: int, end: int) -> DataFrame:
    """As ``execute``, each device's rows from its own segments: one join a tier."""
    metrics, dims = list(pyramid.metrics), list(pyramid.dims)
    lo, hi = _reach(Duration.of(plan.output_bin), start, end, plan.smoothing)
    chain, pieces = pyramid.tier(plan.output_tier), []
    while chain is not None:
        own = segments.where(F.col("tier") == chain.name).select(F.col("device_id").alias("_device"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        rows = tiers[chain.name].where((F.col(TS) >= lo) & (F.col(TS) < hi))
        part = rows.join(own, (F.col("device_id") == F.col("_device")) & (F.col(TS) >= F.col("_start")) & (F.col(TS) < F.col("_end")), "left_semi")
        pieces.append(part if chain.name == plan.output_tier else coarsen(part, str(chain.bin), plan.output_bin, metrics, dims))
        chain = pyramid.source_of(chain.name)
    return _finished(plan, stitch(pieces, metrics, dims), metrics, dims, start, end)


def freshness(recorded: DataFrame, device_ids: list[int] | None = None) -> dict[str, int]:
    """Up to where each tier's recorded shards reach, of the devices asked for the one that lags; a few rows on the driver."""
    rows = recorded if device_ids is None else recorded.where(F.col("device_id").isin(device_ids))
    latest = rows.groupBy("tier", "device_id").agg(F.max("period_end").alias("end")).groupBy("tier").agg(F.min("end").alias("end"))
    return {r["tier"]: r["end"] for r in latest.collect()}


def execute(plan: QueryPlan, pyramid: Pyramid, tiers: dict[str, DataFrame], start: int, end: int, device_ids: list[int] | None = None) -> DataFrame:
    """State rows of the output tier in [start, end), and ``{m}_smooth_*`` state when the plan smooths."""
    metrics, dims = list(pyramid.metrics), list(pyramid.dims)
    pieces = [] if plan.segments else [tiers[plan.output_tier].limit(0)]
    for s in plan.segments:
        part = tiers[s.tier].where((F.col(TS) >= s.start) & (F.col(TS) < s.end))
        if device_ids is not None:
            part = part.where(F.col("device_id").isin(device_ids))
        if s.reaggregate:
            part = coarsen(part, str(pyramid.tier(s.tier).bin), plan.output_bin, metrics, dims)
        pieces.append(part)
    return _finished(plan, stitch(pieces, metrics, dims), metrics, dims, start, end)


def _finished(plan: QueryPlan, out: DataFrame, metrics: list, dims: list[str], start: int, end: int) -> DataFrame:
    """Smoothing, if the plan has any, and the rows of [start, end)."""
    if plan.smoothing:
        state = [c for m in metrics for c in m.state]
        named = {c[: c.rindex("_")] + "_smooth" + c[c.rindex("_") :]: F.col(c) for c in state}
        numbered = out.withColumn("_bin", bin_index(F.col(TS), plan.output_bin))
        reach = plan.smoothing.before + plan.smoothing.after
        out = moving_sums(numbered, "_bin", dims, named, plan.smoothing.before, plan.smoothing.after, chunk=max(4096, 64 * reach)).drop("_bin")
    return out.where((F.col(TS) >= span_of(start, plan.output_bin)[0]) & (F.col(TS) < end))


def build_tiers(pyramid: Pyramid, readings: DataFrame, time: str = "timestamp") -> dict[str, DataFrame]:
    """Every tier, each from the coarsest tier that divides it (lazy; write them to keep)."""
    out: dict[str, DataFrame] = {}
    for tier in pyramid.ordered:
        source = pyramid.source_of(tier.name)
        if source is None:
            out[tier.name] = aggregate_raw(readings, str(tier.bin), list(pyramid.metrics), list(pyramid.dims), time)
        else:
            out[tier.name] = coarsen(out[source.name], str(source.bin), str(tier.bin), list(pyramid.metrics), list(pyramid.dims))
    return out

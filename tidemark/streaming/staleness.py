"""Staleness alerts: a small state machine per device, over a batch of checks or a stream.

Over a batch no task holds a device: what a day of checks makes of any state is one row,
these are folded to the state each day begins with, and the days are folded from there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Alert levels in minutes, and the step to the next by the level reached.
FRESH_MINUTES = 5
FIRST_LEVELS = (5, 15, 60)
STEPS = ((60, 60), (360, 120), (1440, 360), (10_080, 1_440))
SCHEMA = "device_id long, checked_at long, status string, stale_minutes long, level long, first_stale_at long"


@dataclass
class AlertState:
    level: int = 0
    first_stale_at: int = 0


def next_level(level: int) -> int:
    higher = [x for x in FIRST_LEVELS if x > level]
    return higher[0] if higher else level + max((s for s in STEPS if s[0] <= level), default=STEPS[0])[1]


def check(state: AlertState, now: int, last: int | None, month_start: int) -> tuple[str, int, AlertState]:
    """Status, minutes stale and the new state of one check; at most one level rises a check.

    Without any reading a device is stale since the month began.
    """
    since = month_start if last is None else last
    minutes = (now - since) // 60_000
    if last is not None and minutes < FRESH_MINUTES:
        return ("recovered" if state.level else "fresh"), minutes, AlertState() if state.level else state
    after = AlertState(state.level, state.first_stale_at or since)
    level = next_level(state.level)
    if minutes >= level:
        after.level = level
        return "alerted", minutes, after
    return "below-level", minutes, after


DAY_MS = 86_400_000


def _month_start(ms: int) -> int:
    return _month_of(ms // DAY_MS)


@lru_cache(maxsize=4_096)
def _month_of(day: int) -> int:
    at = pd.Timestamp(day * DAY_MS, unit="ms")
    return int(at.replace(day=1).normalize().value // 1_000_000)


def fold(checks: Iterator[tuple[int, int | None]], state: AlertState) -> tuple[list[tuple], AlertState]:
    out = []
    for now, last in checks:
        status, minutes, after = check(state, now, last, _month_start(now))
        out.append((now, status, minutes, after.level, (after if status != "recovered" else state).first_stale_at))
        state = after
    return out, state


def _frame(device: int, rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["checked_at", "status", "stale_minutes", "level", "first_stale_at"])
    frame.insert(0, "device_id", device)
    return frame


def _checks(pdf: pd.DataFrame) -> Iterator[tuple[int, int | None]]:
    ordered = pdf.sort_values("checked_at")
    return ((int(t), None if pd.isna(x) else int(x)) for t, x in zip(ordered.checked_at, ordered.last_at))


#: Stands for the first_stale_at that a chunk was entered with.
KEPT = -(1 << 62)
_LEVELS = [0]


def _rank(minutes: int) -> int:
    """How many levels there are up to ``minutes``."""
    while _LEVELS[-1] <= minutes:
        _LEVELS.append(next_level(_LEVELS[-1]))
    return max(0, bisect_right(_LEVELS, minutes) - 1)


def transition(checks: Iterator[tuple[int, int | None]]) -> tuple:
    """What the checks make of any state: ranks by entry rank, first_stale_at where none was set, and, after a fresh check, the states.

    Until a fresh check a level only climbs: ranks[r] is what rank r became, and ranks
    beyond stay. The first fresh check resets all but states without a level, which keep
    their first_stale_at. ``states``: from a level, from none, from none with first_stale_at set.
    """
    ranks, since, states = np.arange(1), 0, None
    for now, last in checks:
        month = _month_start(now)
        if states is not None:
            states = [check(s, now, last, month)[2] for s in states]
            if len(states) == 3 and states[0] == states[1] == states[2]:
                states = states[:1]
            continue
        status, minutes, after = check(AlertState(), now, last, month)
        if status == "fresh":
            states = [AlertState(), AlertState(0, since), AlertState(0, KEPT)] if ranks[0] == 0 else [AlertState()]
        else:
            top = _rank(minutes)
            ranks = np.append(ranks, np.arange(len(ranks), top + 1))
            ranks += ranks < top
            since = since or after.first_stale_at
    return ranks.tolist(), since, None if states is None else [x for s in states for x in (s.level, s.first_stale_at)]


def enter(state: AlertState, ranks: list[int], since: int, states: list[int] | None) -> AlertState:
    """The state after the checks of a ``transition`` from ``state``."""
    if states is None:
        rank = _rank(state.level)
        after = ranks[rank] if rank < len(ranks) else rank
        while len(_LEVELS) <= after:
            _LEVELS.append(next_level(_LEVELS[-1]))
        return AlertState(_LEVELS[after], state.first_stale_at or since)
    at = 0 if len(states) == 2 or state.level else 2 if state.first_stale_at else 1
    level, first = states[2 * at : 2 * at + 2]
    return AlertState(level, state.first_stale_at if first == KEPT else first)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4_096) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


LONG = pa.int64()


def _transitions(batches):
    def rows():
        for (device, chunk), own in groupby(_rows(batches), key=lambda r: r[:2]):
            yield (device, chunk, *transition(r[2:] for r in own))

    return _batches(rows(), ["device_id", "chunk", "ranks", "since", "states"], [LONG, LONG, pa.list_(LONG), LONG, pa.list_(LONG)], 256)


def _entries(batches):
    def rows():
        for device, own in groupby(_rows(batches), key=lambda r: r[0]):
            state = AlertState()
            for _, chunk, *made in own:
                yield device, chunk, state.level, state.first_stale_at
                state = enter(state, *made)

    return _batches(rows(), ["device_id", "chunk", "level", "first"], [LONG] * 4)


def _folded(batches):
    def rows():
        for _, own in groupby(_rows(batches), key=lambda r: r[:2]):
            state = None
            for device, _, now, last, level, first in own:
                (row,), state = fold(iter([(now, last)]), state or AlertState(level, first))
                yield device, *row

    return _batches(rows(), ["device_id", "checked_at", "status", "stale_minutes", "level", "first_stale_at"], [LONG, LONG, pa.string(), LONG, LONG, LONG])


def alerts(checks: DataFrame) -> DataFrame:
    """The checks (device_id, checked_at, last_at; ms) of each device folded in order.

    Tasks stream sorted rows: the checks by device and day, and one row a day by device.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    cut = checks.select(long("device_id"), F.floor(F.col("checked_at") / DAY_MS).cast("long").alias("chunk"), long("checked_at"), long("last_at"))
    dealt = lambda df, *keys: df.repartition(*keys).sortWithinPartitions("device_id", "chunk", *(c for c in ("checked_at", "last_at") if c in df.columns))
    made = dealt(cut, "device_id", "chunk").mapInArrow(_transitions, "device_id long, chunk long, ranks array<long>, since long, states array<long>")
    entries = dealt(made, "device_id").mapInArrow(_entries, "device_id long, chunk long, level long, first long").select(F.col("device_id").alias("_device"), F.col("chunk").alias("_chunk"), "level", "first")
    entered = cut.join(entries, F.col("device_id").eqNullSafe(F.col("_device")) & (F.col("chunk") == F.col("_chunk"))).drop("_device", "_chunk")
    return dealt(entered, "device_id", "chunk").mapInArrow(_folded, SCHEMA)


# Fixed value: minutes into a month in which its first file may be missing.
GRACE_MINUTES = 5


def last_seen(checks: DataFrame, files: DataFrame) -> DataFrame:
    """The checks (device_id, checked_at; ms) with last_at and ``source``, from files by month (device_id, month as yyyy-MM, written_at).

    The current month's file counts (``current``); without it the check is void within the
    month's first minutes (``too-early``), else the previous month's file counts
    (``previous``), else there are no data (``none``). Void checks are no alert checks.
    """
    at = F.timestamp_millis("checked_at")
    dated = checks.withColumn("_month", F.date_format(at, "yyyy-MM")).withColumn("_previous", F.date_format(F.add_months(at.cast("date"), -1), "yyyy-MM"))
    month = lambda name, out: files.groupBy("device_id", F.col("month").alias(name)).agg(F.max("written_at").alias(out))
    found = dated.join(month("_month", "_own"), ["device_id", "_month"], "left").join(month("_previous", "_older"), ["device_id", "_previous"], "left")
    early = F.col("checked_at") - F.unix_millis(F.date_trunc("month", at)) < GRACE_MINUTES * 60_000
    source = F.when(F.col("_own").isNotNull(), "current").when(early, "too-early").when(F.col("_older").isNotNull(), "previous").otherwise("none")
    last = F.coalesce("_own", F.when(~early, F.col("_older")))
    return found.select("device_id", "checked_at", last.alias("last_at"), source.alias("source"))


def alert_stream(checks: DataFrame) -> DataFrame:
    """The same over a stream of checks, with the state kept between micro-batches."""

    def one(key, frames, state: GroupState):
        now = AlertState(*state.get) if state.exists else AlertState()
        rows, now = fold(_checks(pd.concat(list(frames))), now)
        state.update((now.level, now.first_stale_at))
        yield _frame(key[0], rows)

    return checks.groupBy("device_id").applyInPandasWithState(one, SCHEMA, "level long, first_stale_at long", "append", GroupStateTimeout.NoTimeout)


class Watch(StatefulProcessor):
    """A device's last reading and alert state; a timer checks it every ``every_ms`` though nothing arrives."""

    def __init__(self, every_ms: int, forget_ms: int | None):
        self.every_ms, self.forget_ms = every_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last_at long, level long, first_stale_at long", ttlDurationMs=self.forget_ms)

    def _checked(self, device: int, now: int, last: int, state: AlertState) -> pd.DataFrame:
        (row,), after = fold(iter([(now, last)]), state)
        self.state.update((last, after.level, after.first_stale_at))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.every_ms)
        frame = _frame(device, [row])
        frame["last_at"] = last
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf.ms.max()) for pdf in rows)
        last, level, first = self.state.get() if self.state.exists() else (newest, 0, 0)
        yield self._checked(key[0], timerValues.getCurrentProcessingTimeInMs(), max(newest, last), AlertState(level, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():  # forgotten
            return
        last, level, first = self.state.get()
        yield self._checked(key[0], expiredTimerInfo.getExpiryTimeInMs(), last, AlertState(level, first))

    def close(self) -> None:
        pass


def watch(readings: DataFrame, every_ms: int = 60_000, forget_ms: int | None = None) -> DataFrame:
    """A check of a device whenever readings (device_id, ms) of it arrive and every ``every_ms`` after, so that a silent device raises its alerts by itself.

    Columns as ``alerts`` gives, and last_at. ``forget_ms`` after its last check a device is
    forgotten. The query needs the state store ``deltas.ROCKS`` (see ``deltas.with_rocks``).
    """
    rows = readings.select(F.col("device_id").cast("long").alias("device_id"), F.col("ms").cast("long").alias("ms")).where("ms is not null")
    return rows.groupBy("device_id").transformWithStateInPandas(Watch(every_ms, forget_ms), f"{SCHEMA}, last_at long", "Append", "ProcessingTime")

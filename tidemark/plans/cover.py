"""Which shards a tier should have, and how a coarse shard is tiled from fine ones (driver side)."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.durations import Duration
from ..functions.timeaxis import label_of, periods_overlapping, span_of


@dataclass(frozen=True)
class Slot:
    rung: str
    start: int
    end: int
    effective_start: int
    effective_end: int

    @property
    def label(self) -> str:
        return label_of(self.start, self.rung)


def min_cover(ladder: list[Duration], genesis: int, now: int) -> list[Slot]:
    """Closed periods that cover [genesis, now) with the largest rungs; what only an open smallest-rung period covers stays out.

    The first slot may begin before genesis; its effective start is genesis.
    """
    out: list[Slot] = []
    at = genesis
    while at < now:
        for rung in reversed(ladder):
            start, end = span_of(at, rung)
            if end <= now and (start == at or at == genesis):
                out.append(Slot(str(rung), start, end, max(start, genesis), end))
                at = end
                break
        else:
            break
    return out


def tile(start: int, end: int, have: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """Pieces of ``have`` that fill [start, end) end to end, the longest first at each point; None at a hole."""
    out, at = [], start
    while at < end:
        fit = [h for h in have if h[0] == at and h[1] <= end]
        if not fit:
            return None
        out.append(max(fit, key=lambda h: h[1]))
        at = out[-1][1]
    return out


def source_periods(slot: Slot, rung: Duration) -> list[tuple[int, int]]:
    """Periods of a source rung that the slot's effective range needs."""
    return periods_overlapping(slot.effective_start, slot.effective_end, rung)

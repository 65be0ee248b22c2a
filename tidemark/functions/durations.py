"""Durations such as ``10min``, ``2h``, ``32d``, ``1mo``, ``1y`` (driver side)."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Milliseconds of the units that have a fixed length.
UNIT_MS = {"min": 60_000, "h": 3_600_000, "d": 86_400_000}
CALENDAR = ("mo", "y")


@dataclass(frozen=True)
class Duration:
    count: int
    unit: str

    @classmethod
    def of(cls, text: str | Duration) -> Duration:
        if isinstance(text, Duration):
            return text
        m = re.fullmatch(r"(\d+)(min|h|d|mo|y)", text)
        if not m or not int(m[1]):
            raise ValueError(f"not a duration: {text!r}")
        out = cls(int(m[1]), m[2])
        if out.unit == "mo" and 12 % out.count:
            raise ValueError(f"{text!r}: months must divide a year")
        return out

    @property
    def is_calendar(self) -> bool:
        return self.unit in CALENDAR

    @property
    def ms(self) -> int:
        if self.is_calendar:
            raise ValueError(f"{self} has no fixed length")
        return self.count * UNIT_MS[self.unit]

    @property
    def months(self) -> int:
        return self.count * (12 if self.unit == "y" else 1)

    @property
    def usual_ms(self) -> float:
        """The length, or the mean length of calendar units, to put durations in order."""
        return self.months * 2_629_746_000.0 if self.is_calendar else float(self.ms)

    def divides(self, other: Duration) -> bool:
        """Whether bins of ``other`` are unions of this one's."""
        if not self.is_calendar and not other.is_calendar:
            return other.ms % self.ms == 0
        if not self.is_calendar:
            return UNIT_MS["d"] % self.ms == 0
        return other.is_calendar and other.months % self.months == 0

    def __str__(self) -> str:
        return f"{self.count}{self.unit}"

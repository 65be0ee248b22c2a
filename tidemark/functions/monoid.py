"""Mergeable state of a metric, as aggregate Columns: init from readings, merge, finalize.

``sum`` keeps count, sum and sum of squares; ``count`` the count alone; ``hll`` a sketch of
distinct values; ``topk`` and ``botk`` the k highest or lowest values; ``histogram`` the
counts of values by their bucket of ``width``; ``quantile`` a sketch that ranks values.
State merges with state of the same metric in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a metric's state is called by its monoid.
STATES = {"sum": ("n", "sum", "sumsq"), "count": ("n",), "hll": ("hll",), "topk": ("topk",), "botk": ("botk",), "histogram": ("histogram",), "quantile": ("quantile",)}
STATE_TYPES = {"n": "long", "sum": "double", "sumsq": "double", "hll": "binary", "topk": "array<double>", "botk": "array<double>", "histogram": "map<bigint,bigint>", "quantile": "binary"}


def coerce(value: Column) -> Column:
    """A number as double; text that is none, and NaN, as null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Metric:
    """``value``: an expression over readings; ``scale``: decimal places for exact, order-free sums; ``k`` and ``width`` for the monoids that need them."""

    name: str
    value: str
    monoid: str = "sum"
    scale: int | None = None
    k: int = 10
    width: float = 1.0

    def __post_init__(self):
        if self.monoid not in STATES:
            raise ValueError(f"unknown monoid {self.monoid!r}")

    @property
    def state(self) -> list[str]:
        return [f"{self.name}_{s}" for s in STATES[self.monoid]]

    @property
    def listed(self) -> bool:
        """Whether the state is a list or map, built in two steps so that no task holds a bin's readings."""
        return self.monoid in ("topk", "botk", "histogram")

    @property
    def state_types(self) -> list[str]:
        return [STATE_TYPES[s] for s in STATES[self.monoid]]

    def init(self) -> list[Column]:
        v, out = coerce(F.expr(self.value)), self.state[0]
        if self.monoid == "hll":
            return [F.hll_sketch_agg(F.expr(self.value).cast("string")).alias(out)]
        if self.listed:
            raise ValueError(f"{self.monoid} has no single aggregate; see operators.rollup.listed_state")
        if self.monoid == "quantile":
            return [F.kll_sketch_agg_double(v).alias(out)]
        n = F.count(v).alias(out)
        if self.monoid == "count":
            return [n]
        if self.scale is not None:
            v = v.cast(f"decimal(18,{self.scale})")
        return [n, F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias(self.state[1]), F.coalesce(F.sum(v * v).cast("double"), F.lit(0.0)).alias(self.state[2])]

    def merge(self) -> list[Column]:
        out = self.state[0]
        if self.monoid == "hll":
            return [F.hll_union_agg(out).alias(out)]
        if self.listed:
            raise ValueError(f"{self.monoid} has no single merge; see operators.rollup.merged")
        if self.monoid == "quantile":
            return [F.kll_merge_agg_double(out).alias(out)]
        merged = [F.coalesce(F.sum(out), F.lit(0)).cast("long").alias(out)]
        for s, scale in zip(self.state[1:], (self.scale, None if self.scale is None else 2 * self.scale)):
            column = F.col(s) if scale is None else F.col(s).cast(f"decimal(28,{scale})")
            merged.append(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias(s))
        return merged

    def mean(self) -> Column:
        n, total = (F.col(s) for s in self.state[:2])
        return F.when(n > 0, total / n)

    def stddev(self) -> Column:
        """Population deviation; null without readings."""
        n, _, squares = (F.col(s) for s in self.state)
        return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), squares / n - self.mean() * self.mean())))

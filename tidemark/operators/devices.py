"""The device table: device_id, name, device_type, genesis (ms), active, refreshed_at (ms)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import read_or_empty

SCHEMA = "device_id long, name string, device_type string, genesis long, active boolean, refreshed_at long"


def active(devices: DataFrame) -> DataFrame:
    """Devices but for those marked inactive; without a mark a device is active. In order of id."""
    return devices.where(F.coalesce("active", F.lit(True))).orderBy("device_id")


def override(devices: DataFrame, overrides: DataFrame) -> DataFrame:
    """Devices with the values that ``overrides`` (device_id and any of the columns) holds for them; nulls there change nothing."""
    changed = [c for c in overrides.columns if c != "device_id" and c in devices.columns]
    own = overrides.select("device_id", *(F.col(c).alias(f"_{c}") for c in changed))
    joined = devices.join(own, "device_id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in devices.columns))


def upsert(devices: DataFrame, new: DataFrame) -> DataFrame:
    """One row a device: the new one where there is one, whole."""
    rest = [c for c in devices.columns if c != "device_id"]
    both = devices.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy("device_id").agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return best.select("device_id", *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*devices.columns)


def bootstrap(devices: DataFrame, readings: DataFrame, now: int, ms: str = "ms") -> DataFrame:
    """Active devices with the start of their first reading's minute as genesis, for ``upsert``; those without readings stay out."""
    first = readings.groupBy("device_id").agg(F.min(ms).alias("_first"))
    found = active(devices).join(first, "device_id")
    genesis = F.col("_first") - F.pmod("_first", F.lit(60_000))
    return found.withColumn("genesis", genesis).withColumn("refreshed_at", F.lit(now).cast("long")).drop("_first")


def listed(spark: SparkSession, path: str, fetch: Callable[[], list[dict]], overrides: DataFrame | None = None, ttl_s: float = 3600, refresh: bool = False, now: int | None = None) -> DataFrame:
    """The device list kept at ``path`` while it is younger than ``ttl_s``, else from ``fetch``, kept again if that can be written.

    A list that can't be written is still returned. ``fetch`` gives dicts of the columns.
    """
    now = int(time.time() * 1000) if now is None else now
    schema = StructType.fromDDL(SCHEMA)
    held = read_or_empty(spark, path, schema)
    newest = held.agg(F.max("refreshed_at")).first()[0]
    if refresh or newest is None or now - newest > ttl_s * 1000:
        rows = [{f.name: d.get(f.name) for f in schema} | {"refreshed_at": now} for d in fetch()]
        held = spark.createDataFrame(rows, schema)
        try:
            held.coalesce(1).write.mode("overwrite").parquet(path)
        except Exception:  # the cache is a convenience
            pass
    return held if overrides is None else override(held, overrides)

"""Readings and tiers in Parquet: layouts, scans, sinks, and what the files say of themselves."""

from __future__ import annotations

import re
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.utils import AnalysisException

from ..functions.durations import Duration
from ..functions.monoid import Metric
from ..functions.timeaxis import PATTERNS, bin_end, label_of, period_label
from ..operators.ingest import FIELDS, outcomes
from ..operators.rollup import TS
from ..plans.pyramid import Pyramid, Tier, key_pattern
from .commits import Versioned

#: Schemes of the stores that pyarrow opens by itself.
KNOWN_STORES = "^(file|s3|gs|gcs|hdfs|abfs|abfss):"
READING_SCHEMA = StructType([StructField(FIELDS[0], TimestampType())] + [StructField(f, DoubleType()) for f in FIELDS[1:]])


def tier_schema(metrics: list[Metric]) -> StructType:
    state = ", ".join(f"`{s}` {t}" for m in metrics for s, t in zip(m.state, m.state_types))
    return StructType([StructField("device_id", LongType()), StructField(TS, LongType()), *StructType.fromDDL(state)])


def read_or_empty(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """The files at ``path``, or no rows where there are none."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


MONTHS = "[0-9][0-9][0-9][0-9]-[0-9][0-9].parquet"


def read_monthly(spark: SparkSession, base: str, schema: StructType = READING_SCHEMA, time: str | None = None) -> DataFrame:
    """The files named YYYY-MM.parquet under ``base`` as one table, in order of ``time`` where given; no rows without the folder."""
    rows = read_or_empty(spark, base, schema, pathGlobFilter=MONTHS)
    return rows if time is None else rows.orderBy(time)


def monthly_files(spark: SparkSession, base: str) -> list[str]:
    """Paths of the files named YYYY-MM.parquet under ``base``, in order; none without the folder."""
    return sorted(r["path"] for r in listing(spark, base, MONTHS).select("path").collect())


def read_device(spark: SparkSession, base: str, schema: StructType = READING_SCHEMA) -> DataFrame:
    """A device's readings: the monthly files in folder ``base`` if there is one, else the single file ``base``.parquet."""
    return read_monthly(spark, base, schema) if monthly_files(spark, base) else read_or_empty(spark, f"{base.rstrip('/')}.parquet", schema)


def with_device(df: DataFrame, pattern: str = r"device[-_=](\d+)") -> DataFrame:
    """``df`` of a scan with device_id taken from each file's path (null where it names none)."""
    return df.withColumn("device_id", F.col("_metadata.file_path")).withColumn("device_id", F.regexp_extract("device_id", pattern, 1).try_cast("long"))


def write_monthly(df: DataFrame, base: str, time: str = "timestamp", files_a_month: int = 8, row_group_rows: int | None = None) -> None:
    """Month directories, rows in order of time; a write replaces the months it holds and no other.

    A month is dealt to ``files_a_month`` tasks by spans of its days, so files don't overlap in time.
    """
    _row_groups(_by_month(df, time, files_a_month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic"), row_group_rows).partitionBy("month").parquet(base)


def _by_month(df: DataFrame, time: str, files_a_month: int = 8) -> DataFrame:
    months = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    span = F.floor((F.dayofmonth(time) - 1) * files_a_month / 31)
    return months.repartition("month", span).sortWithinPartitions("month", time)


def _row_groups(writer, rows: int | None):
    return writer if rows is None else writer.option("parquet.block.row.count.limit", str(rows))


def write_month_files(df: DataFrame, base: str, time: str = "timestamp") -> list[str]:
    """One device's readings as a file a month, named YYYY-MM.parquet, in order of time; the names. A month's file replaces the one there is."""
    spark, draft = df.sparkSession, f"{base.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    months = df.withColumn("month", F.date_format(time, "yyyy-MM")).repartition("month").sortWithinPartitions("month", time)
    months.write.partitionBy("month").parquet(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, names = path(draft).getFileSystem(spark._jsc.hadoopConfiguration()), []
    for month in fs.listStatus(path(draft)):
        label = month.getPath().getName().removeprefix("month=")
        for part in fs.listStatus(month.getPath()) if month.isDirectory() else ():
            target = path(f"{base.rstrip('/')}/{label}.parquet")
            fs.delete(target, False)
            fs.rename(part.getPath(), target)
            names.append(f"{label}.parquet")
    fs.delete(path(draft), True)
    return sorted(names)


def monthly_table(spark: SparkSession, base: str, schema: StructType) -> Versioned:
    """A table of readings by month whose writes become visible at once."""
    return Versioned(spark, base, StructType([*schema, StructField("month", StringType())]), ("month",))


def merge_monthly(spark: SparkSession, base: str, new: DataFrame, keys: list[str], values: list[str], time: str = "timestamp", on_conflict: str = "warn", expected: int | None = None) -> bool:
    """Merge ``new`` into a monthly table (``monthly_table``) and replace the months it changes; False, and nothing written, where it brings nothing new.

    Where ``on_conflict`` is ``warn``, a warning tells how many keys have readings that differ.
    All months change at once, or none; if another writer has changed one of them since
    the table was read, or the table isn't at the version ``expected``, StaleVersion is raised.
    """
    columns = [*keys, *values]
    table = monthly_table(spark, base, new.select(*columns).schema)
    version = table.version() if expected is None else expected
    month = F.date_format(time, "yyyy-MM").alias("month")
    near = table.read(version).join(new.select(month).distinct(), "month", "left_semi").select(*columns)
    out = outcomes(near, new, keys, values, on_conflict == "replace").withColumn("month", month)
    told = out.groupBy("month").agg(F.count_if(F.col("added") | (F.col("differs") & F.lit(on_conflict == "replace"))).alias("changed"), F.count_if("differs").alias("conflicts")).collect()  # a few months
    differ, names = sum(r["conflicts"] for r in told), [r["month"] for r in told if r["changed"]]
    if differ and on_conflict == "error":
        raise ValueError("readings with equal keys differ")
    if differ and on_conflict == "warn":
        warnings.warn(f"{differ} keys have readings that differ; those stored stay", stacklevel=2)
    if not names:
        return False
    table.commit(_by_month(out.where(F.col("month").isin(names)).select(*columns), time), expected=version)
    return True


#: Groups of devices by a hash of the id; each has files of its own in every partition of a tier.
BUCKETS = 8


def bucket_of(device: str = "device_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int")


def tier_table(spark: SparkSession, base: str, name: str, schema: StructType) -> Versioned:
    """A stored tier: by ``part`` (the day or month in which bins begin) and group of devices."""
    return Versioned(spark, f"{base}/tier={name}", StructType([*schema, StructField("part", StringType()), StructField("bucket", IntegerType())]), ("part", "bucket"))


def parts_between(tier: Tier, start: int, end: int):
    """Whether a stored partition begins in [start, end), both on its edges, as a condition on ``part``."""
    return (F.col("part") >= label_of(start, tier.part)) & (F.col("part") <= label_of(end - 1, tier.part))


def write_tier(state: DataFrame, base: str, tier: Tier, buckets: int = BUCKETS, row_group_rows: int | None = None, replaced=None, expected: int | None = None) -> int:
    """A tier's rows, sorted by device and time, as the next version of the stored tier; the version.

    Replaces the partitions for which ``replaced`` holds (on ``part`` and ``bucket``), else those it
    has rows of. A busy day spreads over its groups of devices; a query's device and time
    filters skip the rest by the files' and pages' statistics. Row groups have the writer's
    usual size in bytes unless their rows are given.
    """
    dealt = state.withColumn("part", period_label(F.col(TS), tier.part.unit)).withColumn("bucket", bucket_of(buckets=buckets)).repartition("part", "bucket").sortWithinPartitions("part", "bucket", "device_id", TS)
    options = {} if row_group_rows is None else {"parquet.block.row.count.limit": str(row_group_rows)}
    return tier_table(state.sparkSession, base, tier.name, state.schema).commit(dealt, replaced, expected=expected, options=options)


def read_tier(spark: SparkSession, base: str, tier: Tier, metrics: list[Metric], start: int, end: int) -> DataFrame:
    """Rows of a tier in [start, end): partitions prune first, row groups by ts next."""
    label = lambda ms: period_label(F.lit(ms), tier.part.unit)
    rows = tier_table(spark, base, tier.name, tier_schema(metrics)).read()
    return rows.where((F.col("part") >= label(start)) & (F.col("part") <= label(end - 1)) & (F.col(TS) >= start) & (F.col(TS) < end)).drop("part", "bucket")


def rewrite(spark: SparkSession, source: str, target: str, row_group_rows: int) -> None:
    """The same rows with another row-group length."""
    _row_groups(spark.read.parquet(source).write, row_group_rows).parquet(target)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, times in ISO form, null fields kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object, null fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def listing(spark: SparkSession, base: str, glob: str = "*.parquet") -> DataFrame:
    """path, size and modification time of the files under ``base``, without reading them; no rows where there is nothing."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size_bytes long, written_at long")
    return files.select("path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("written_at"))


def head(spark: SparkSession, path: str):
    """path, size_bytes and written_at of one file; None where there is none."""
    return listing(spark, path, "*").first()


def tiers_written(spark: SparkSession, base: str) -> dict[str, int]:
    """When a file of each stored tier was last written (ms): how fresh each tier is."""
    named = listing(spark, base).withColumn("tier", F.regexp_extract("path", "/tier=([^/]+)/", 1)).where("tier <> ''")
    return {r["tier"]: r["at"] for r in named.groupBy("tier").agg(F.max("written_at").alias("at")).collect()}


FOOTER_SCHEMA = "path string, size_bytes long, n_rows long, n_rgs long, rg_row_counts array<long>"


def _footer(path: str, size: int, source) -> tuple:
    import pyarrow.parquet as pq

    m = pq.ParquetFile(source).metadata
    return path, size, m.num_rows, m.num_row_groups, [m.row_group(i).num_rows for i in range(m.num_row_groups)]


def footers(spark: SparkSession, base: str, glob: str = "*.parquet") -> DataFrame:
    """path, size_bytes, n_rows, n_rgs and rg_row_counts of Parquet files under ``base``.

    Tasks read each file's tail alone, where pyarrow knows the store; of other stores Spark
    reads the file.
    """
    import io

    import pandas as pd
    from pyarrow import fs

    names = [c.split()[0] for c in FOOTER_SCHEMA.split(", ")]

    def tails(batches):
        for pdf in batches:
            out = []
            for path, size in zip(pdf.path, pdf.size_bytes):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    out.append(_footer(path, size, f))
            yield pd.DataFrame(out, columns=names)

    def wholes(batches):
        for pdf in batches:
            yield pd.DataFrame([_footer(p, len(c), io.BytesIO(c)) for p, c in zip(pdf.path, pdf.content)], columns=names)

    files = listing(spark, base, glob).select("path", "size_bytes")
    if not files.where(~F.col("path").rlike(KNOWN_STORES)).isEmpty():
        content = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(base)
        return content.select("path", "content").mapInPandas(wholes, FOOTER_SCHEMA)
    return files.repartition(max(1, min(200, files.count() // 16))).mapInPandas(tails, FOOTER_SCHEMA)


def row_group_length(spark: SparkSession, path: str) -> int | None:
    """Rows of the first row group of a Parquet file; None for a missing or empty one."""
    if head(spark, path) is None:
        return None
    found = footers(spark, path, "*").first()
    return found["rg_row_counts"][0] if found["rg_row_counts"] else None


def parse_keys(paths: DataFrame, path: str = "path", key: str = Pyramid.key) -> DataFrame:
    """``paths`` with device_id, tier, rung and label of those that end as the key template says; others go."""
    pattern = key_pattern(key)
    order = re.findall(r"\{(\w+)\}", key)
    part = lambda name: F.regexp_extract(path, pattern, order.index(name) + 1)
    return paths.where(F.col(path).rlike(pattern)).select("*", part("device_id").cast("long").alias("device_id"), part("tier").alias("tier"), part("shard").alias("rung"), part("period").alias("label"))


def bootstrap_registry(spark: SparkSession, base: str, ladders: dict[str, list[str]], key: str = Pyramid.key) -> DataFrame:
    """Registry rows of the shard files under ``base`` whose tier, rung and label are valid."""
    keys = parse_keys(listing(spark, base), key=key)
    allowed = spark.createDataFrame([(t, r, Duration.of(r).unit) for t, rungs in ladders.items() for r in rungs], "tier string, rung string, unit string")
    start = F.coalesce(*(F.when(F.col("unit") == u, F.unix_millis(F.try_to_timestamp("label", F.lit(p)))) for u, p in PATTERNS.items()))
    rows = keys.join(allowed, ["tier", "rung"]).withColumn("period_start", start).where("period_start is not null")
    end = F.coalesce(*(F.when(F.col("rung") == r, bin_end(F.col("period_start"), r)) for r in sorted({r for rungs in ladders.values() for r in rungs})))
    return rows.select("device_id", "tier", "rung", "period_start", end.alias("period_end"), F.col("path").alias("key"), "written_at", "size_bytes")

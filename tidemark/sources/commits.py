"""Tables of Parquet files whose writes become visible at once.

A write puts its files into a folder of its own, by the table's partitions. A manifest, a
table itself, says for each partition which folder's files count; a small file in
``_versions``, put there by a rename that fails if the name is taken, makes the manifest
the next version. Readers see the last version, whole; what a failed or
outrun writer leaves is in no manifest, and ``vacuum`` removes it.

A write names what it replaces: partitions (by a condition), the partitions it holds, or
the rows of the keys it holds, whose neighbours in the same partitions are carried over.
Of two writers from one version the second is told (``StaleVersion``), unless neither
expected a version and they changed different partitions.

Partition columns may not be null. The driver handles names of folders and versions, no rows.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class StaleVersion(RuntimeError):
    """Another writer changed what this one was about to replace."""


@dataclass(frozen=True)
class Versioned:
    """``schema``: all columns, those of ``parts``, the partitions, among them."""

    spark: SparkSession
    path: str
    schema: StructType
    parts: tuple[str, ...]

    # Versions ------------------------------------------------------------------------------

    def _jvm_path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._jvm_path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        at = self._jvm_path(*folder)
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The last version; 0 before the first write."""
        return max((int(n) for n in self._names("_versions") if n.isdigit()), default=0)

    def _manifest_of(self, version: int) -> str:
        stream = self._fs().open(self._jvm_path("_versions", f"{version:020d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @property
    def _places(self) -> StructType:
        return StructType([self.schema[p] for p in self.parts] + [StructField("folder", StringType())])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The partitions of a version and the folder of each."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], self._places)
        return self.spark.read.schema(self._places).orc(f"{self.path}/_manifests/{self._manifest_of(at)}")

    def _publish(self, version: int, manifest: str) -> bool:
        """Make a manifest the given version; False if there is such a version by now."""
        draft, final = self._jvm_path("_versions", f".{manifest}"), self._jvm_path("_versions", f"{version:020d}")
        out = self._fs().create(draft, True)
        out.write(bytearray(manifest.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # Reading ---------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default; filters on partitions and columns reach the scan."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema, StructField("folder", StringType())])).parquet(self.path)
        return rows.join(self.manifest(at), [*self.parts, "folder"], "left_semi").select(*self.schema.names)

    # Writing ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, folder: str, options: dict[str, str]) -> None:
        rows.select(*self.schema.names).write.mode("append").options(**options).partitionBy(*self.parts).parquet(f"{self.path}/folder={folder}")

    def _written(self, folder: str) -> DataFrame:
        """The partitions that a folder holds, by its names."""
        top, found = self._jvm_path(f"folder={folder}"), set()
        fs = self._fs()
        files = fs.listFiles(top, True) if fs.exists(top) else None
        while files is not None and files.hasNext():
            inside = files.next().getPath().getParent().toString().rpartition(f"folder={folder}")[2]
            values = tuple(unquote(v) for v in re.findall(r"=([^/]*)", inside))
            if len(values) == len(self.parts):
                found.add(values)
        kinds = [self.schema[p].dataType for p in self.parts]
        text = StructType([StructField(p, StringType()) for p in self.parts])
        return self.spark.createDataFrame(sorted(found), text).select(*(F.col(p).cast(k).alias(p) for p, k in zip(self.parts, kinds)), F.lit(folder).alias("folder"))

    def commit(self, rows: DataFrame, replaced: Column | None = None, keys: list[str] | None = None, expected: int | None = None, options: dict[str, str] | None = None) -> int:
        """Write ``rows`` and make them the next version, whose number is returned.

        Partitions for which ``replaced`` holds are replaced whole, those without new rows
        go; without it those that the rows hold. With ``keys`` rows of other keys in those
        partitions stay. ``expected``: the version that the rows were made from.
        """
        base = self.version()
        if expected is not None and expected != base:
            raise StaleVersion(f"{self.path}: version {expected} expected, {base} found")
        folder = uuid.uuid4().hex
        self._write(rows, folder, options or {})
        new = self._written(folder)
        if keys is not None:
            fresh = self.spark.read.schema(self.schema).parquet(f"{self.path}/folder={folder}") if not new.isEmpty() else None
            if fresh is not None:
                beside = self.read(base).join(new.select(*self.parts), list(self.parts), "left_semi")
                self._write(beside.join(fresh.select(*keys).distinct(), keys, "left_anti"), folder, options or {})
        gone = F.lit(False) if replaced is None else F.coalesce(replaced, F.lit(False))
        while True:
            held = self.manifest(base)
            touched = held.where(gone).select(*self.parts).unionByName(new.select(*self.parts)).distinct()
            kept = held.where(~gone).join(new.select(*self.parts), list(self.parts), "left_anti")
            kept.unionByName(new).coalesce(1).write.orc(f"{self.path}/_manifests/{(name := uuid.uuid4().hex)}")
            if self._publish(base + 1, name):
                return base + 1
            after = self.version()
            changed = reduce(DataFrame.union, [a.exceptAll(b) for a, b in ((self.manifest(after), held), (held, self.manifest(after)))])
            if expected is not None or not changed.where(gone).isEmpty() or not changed.join(touched, list(self.parts), "left_semi").isEmpty():
                raise StaleVersion(f"{self.path}: version {after} changed partitions that were to be replaced")
            base = after

    def vacuum(self, keep: int = 1) -> int:
        """Remove the files that none of the last ``keep`` versions reads, and these versions' elders; how many folders went. No writer may run meanwhile."""
        last, fs = self.version(), self._fs()
        live_versions = [v for v in range(max(1, last - keep + 1), last + 1)]
        manifests = {self._manifest_of(v) for v in live_versions}
        live = reduce(DataFrame.union, [self.manifest(v) for v in live_versions], self.manifest(0)).distinct()
        folders = {r["folder"] for r in live.select("folder").distinct().collect()}  # a folder a write
        removed = 0
        for name in self._names():
            if name.startswith("folder=") and name.removeprefix("folder=") not in folders:
                fs.delete(self._jvm_path(name), True)
                removed += 1
        for name in self._names("_manifests"):
            if name not in manifests:
                fs.delete(self._jvm_path("_manifests", name), True)
        for name in self._names("_versions"):
            if not name.isdigit() or int(name) not in live_versions:
                fs.delete(self._jvm_path("_versions", name), False)
        return removed

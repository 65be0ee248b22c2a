"""A REST source of sensor readings, as Spark data sources.

Option ``pages`` names a function ``module:function`` of (device_id, from_ms, to_ms,
limit) that returns a page: {"data": [{"timestamp", "sensors": [{"comp", "value"}]}]}, or
raises ``HttpError``. The range is cut into slices of ``slice_hours``, one task each; a
task walks its slice backwards a page at a time: on from a second before the oldest
reading, a minute back where a page makes no progress, an hour back after an error, and
no further after a page without data, ``max_requests`` of the slice, or a rate limit
(``on_rate_limit`` ``stop``; ``fail`` raises, so that Spark tries the task again).

``readings`` gives the readings, ``reading_requests`` one row a request: what was asked for
and what came of it.

As a stream, ``readings`` has an offset a device, up to where it has been read. A batch
takes the devices that lag most a slice further, as many as ``max_requests`` of the batch
allow at ``requests_a_slice`` each, and none beyond now. A batch that wasn't committed is
read again with the same slices. ``progress`` names a file in the shared folder that keeps
the offsets planned last, so that a restarted query plans on from there.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.ingest import delete_range

PAGE_TYPE = "struct<data: array<struct<timestamp: string, sensors: array<struct<comp: string, value: double>>>>>"


def flatten(pages: DataFrame, page: Column, fields: list[str]) -> DataFrame:
    """timestamp and one column a field from JSON pages; a sensor that is not there is null."""
    rows = pages.select(F.explode(F.from_json(page, PAGE_TYPE)["data"]).alias("r"))
    sensors = F.map_from_entries(F.transform(F.col("r.sensors"), lambda s: F.struct(s["comp"], s["value"])))
    return rows.withColumn("_s", sensors).select(F.col("r.timestamp").cast("timestamp").alias("timestamp"), *(F.try_element_at("_s", F.lit(f)).alias(f) for f in fields))


class HttpError(Exception):
    """What a page function raises for an HTTP status other than success."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(status, message)
        self.status = status


class Slice(InputPartition):
    def __init__(self, device_id: int, start: int, end: int):
        self.device_id, self.start, self.end = device_id, start, end


def _ms(stamp: str) -> int:
    return int(datetime.fromisoformat(stamp.replace("Z", "+00:00")).astimezone(timezone.utc).timestamp() * 1000)


def walk(fetch, part: Slice, limit: int, max_requests: int | None = None, on_rate_limit: str = "stop") -> Iterator[tuple[tuple, list[tuple[int, dict]]]]:
    """Each request of a slice, newest first: its report (a row of ``REQUEST_SCHEMA``) and its readings with their times."""
    to, made = part.end, 0
    while to > part.start and (max_requests is None or made < max_requests):
        made += 1
        asked = (part.device_id, part.start, to)
        try:
            data = fetch(part.device_id, part.start, to, limit)["data"]
        except HttpError as e:
            if e.status == 429:
                if on_rate_limit == "fail":
                    raise
                yield (*asked, "rate_limit", 0, None, None, None), []
                return
            yield (*asked, "http_error", 0, None, None, None), []
            to -= 3_600_000
            continue
        rows = [(_ms(r["timestamp"]), r) for r in data]
        times = [t for t, _ in rows]
        first, last = min(times, default=None), max(times, default=None)
        yield (*asked, "ok", len(rows), first, last, (last - first) / 1000 / (len(rows) - 1) if len(rows) > 1 else None), rows
        if not rows:
            return
        to = first - 1_000 if first < to else to - 60_000


REQUEST_SCHEMA = "device_id long, requested_from long, requested_to long, outcome string, records long, actual_from long, actual_to long, mean_interval_s double"


class ReadingsSource(DataSource):
    """``spark.dataSource.register(ReadingsSource)``, then format("readings")."""

    @classmethod
    def name(cls):
        return "readings"

    def schema(self):
        return "device_id long, timestamp timestamp, comp string, value double"

    def reader(self, schema):
        return ReadingsReader(self.options)

    def streamReader(self, schema):
        return ReadingsStream(self.options)


class RequestsSource(ReadingsSource):
    """``spark.dataSource.register(RequestsSource)``, then format("reading_requests")."""

    @classmethod
    def name(cls):
        return "reading_requests"

    def schema(self):
        return REQUEST_SCHEMA

    def reader(self, schema):
        return RequestsReader(self.options)


class ReadingsReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        o = self.options
        step = int(float(o.get("slice_hours", "24")) * 3_600_000)
        start, end = int(o["from"]), int(o["to"])
        return [Slice(int(d), at, min(end, at + step)) for d in o["devices"].split(",") for at in range(start, end, step)]

    def _walk(self, part):
        module, _, function = self.options["pages"].partition(":")
        most = self.options.get("max_requests") if not isinstance(self, ReadingsStream) else None  # a batch's, there
        return walk(getattr(importlib.import_module(module), function), part, int(self.options.get("limit", "360")), int(most) if most else None, self.options.get("on_rate_limit", "stop"))

    def read(self, part):
        for _, rows in self._walk(part):
            for ms, row in rows:
                if part.start <= ms < part.end:
                    at = datetime.fromtimestamp(ms / 1000, timezone.utc)
                    for s in row["sensors"]:
                        yield part.device_id, at, s["comp"], float(s["value"])


class ReadingsStream(ReadingsReader, DataSourceStreamReader):
    """Offsets are {device: ms}, planned ahead and kept before Spark sees them, so they never fall behind those that Spark has logged."""

    def __init__(self, options):
        super().__init__(options)
        o = self.options
        self.slice = int(float(o.get("slice_hours", "24")) * 3_600_000)
        self.most = max(1, int(o.get("max_requests", "1000000")) // int(o.get("requests_a_slice", "4")))
        self.planned = self._kept() or self.initialOffset()
        self.told = self.used = None  # the offset that was given last, and the last that Spark took up

    def _file(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["progress"]) if "://" in self.options["progress"] or self.options["progress"].startswith("file:") else (fs.LocalFileSystem(), self.options["progress"])

    def _kept(self) -> dict | None:
        if "progress" not in self.options:
            return None
        store, path = self._file()
        if not store.get_file_info(path).is_file:
            return None
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        if "progress" in self.options:
            store, path = self._file()
            with store.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(self.planned).encode())
            store.move(f"{path}.new", path)

    def _now(self) -> int:
        return int(self.options["until"]) if "until" in self.options else int(datetime.now(timezone.utc).timestamp() * 1000)

    def initialOffset(self) -> dict:
        return {d: int(self.options["from"]) for d in self.options["devices"].split(",")}

    def latestOffset(self) -> dict:
        if self.told is not None and self.told in (self.planned, self.used):  # taken up, or nothing new to Spark
            lagging = sorted(self.planned, key=lambda d: (self.planned[d], d))[: self.most]
            ahead = self.planned | {d: max(self.planned[d], min(self._now(), self.planned[d] + self.slice)) for d in lagging}
            if ahead != self.planned:
                self.planned = ahead
                self._keep()
        self.told = self.planned
        return dict(self.planned)

    def partitions(self, start, end):
        self.used = end
        self.planned = {d: max(self.planned.get(d, at), at) for d, at in end.items()}
        return [Slice(int(d), start.get(d, int(self.options["from"])), at) for d, at in end.items() if start.get(d, int(self.options["from"])) < at]

    def commit(self, end):
        pass  # what was planned is kept already


class RequestsReader(ReadingsReader):
    def read(self, part):
        for report, _ in self._walk(part):
            yield report


def replace_range(held: DataFrame, fetched: DataFrame, start: int, end: int, time: str = "timestamp") -> DataFrame:
    """What is held without its readings in [start, end] (ms), and the fetched ones."""
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    return delete_range(held, time, at(start), at(end)).unionByName(fetched)

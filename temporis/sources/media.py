"""Media metadata as a source of Spark's own: spark.read.format("temporis_media"), and a sink of results that commits.

The source lists a folder through any store that Arrow opens, and yields a row a file: path, video_id, bytes, modified and what a probe plug-in
tells of it (duration, fps, width, height, status). A partition is some files; a probe is given a path, never a file's content, and opens what it
needs. Filters on path, video_id and bytes reach the listing, so files that they leave out are never probed. As a stream the source
yields files as they come, in order of modification.

The sink, "temporis_results", writes JSON lines. Tasks write to files of their attempt; the commit renames those that succeeded and leaves a mark of the
batch, so a run that is tried again, or a batch of a stream that comes twice, is written once.
"""

from __future__ import annotations

import datetime
import importlib
import json
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql import SparkSession

SCHEMA = "path string, video_id string, bytes long, modified timestamp, duration double, fps double, width int, height int, status string"
#: Files of a partition, where the option files_per_partition isn't given.
PER_PARTITION = 64


class MediaFile(NamedTuple):
    path: str
    size: int
    nanos: int

    @property
    def video_id(self) -> str:
        return self.path.rpartition("/")[2].partition(".")[0]


class _Files(InputPartition):
    def __init__(self, files: list[MediaFile]) -> None:
        super().__init__(0)
        self.files = files


def listed(path: str, pattern: str) -> list[MediaFile]:
    """Files below a path whose names match, in order of path."""
    store, at = fs.FileSystem.from_uri(path)
    prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    files = [MediaFile(prefix + x.path, x.size, x.mtime_ns or 0) for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, pattern) and not x.base_name.startswith((".", "_"))]
    return sorted(files)


def plugin(name: str):
    """The function that "module:name" says."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def probed(files: list[MediaFile], probe: str | None) -> Iterator[tuple]:
    """Rows of files. What the plug-in can't open, raising or returning None, has nulls and the status failed; without a plug-in nothing is told."""
    tell = plugin(probe) if probe else None
    for f in files:
        try:
            got = tell(f.path) if tell else {}
        except Exception:  # a plug-in may raise anything; the row says that it failed
            got = None
        modified = datetime.datetime.fromtimestamp(f.nanos / 1e9)
        status = "unprobed" if tell is None else "failed" if got is None else "ok"
        yield f.path, f.video_id, f.size, modified, *((got or {}).get(k) for k in ("duration", "fps", "width", "height")), status


class MediaSource(DataSource):
    """Options: path, pattern (*), probe ("module:function"), files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "temporis_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)

    def streamReader(self, schema) -> MediaStream:
        return MediaStream(self.options)


class _Reading:
    def __init__(self, options) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.probe, self.size = options.get("probe"), int(options.get("files_per_partition", PER_PARTITION))

    def parts(self, files: list[MediaFile]) -> list[_Files]:
        return [_Files(files[k : k + self.size]) for k in range(0, len(files), self.size)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return probed(partition.files, self.probe)


#: How a filter that reached the source is decided for a file's value.
_RULES = {
    EqualTo: lambda value, x: value == x, In: lambda value, x: value in x, StringStartsWith: lambda value, x: value.startswith(x),
    GreaterThan: lambda value, x: value > x, GreaterThanOrEqual: lambda value, x: value >= x, LessThan: lambda value, x: value < x, LessThanOrEqual: lambda value, x: value <= x,
}
_VALUES = {"path": lambda f: f.path, "video_id": lambda f: f.video_id, "bytes": lambda f: f.size}


class MediaReader(_Reading, DataSourceReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters that a listing decides; Spark keeps the others."""
        for f in filters:
            if type(f) in _RULES and len(f.attribute) == 1 and f.attribute[0] in _VALUES and getattr(f, "value", None) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        keep = lambda file: all(_RULES[type(f)](_VALUES[f.attribute[0]](file), f.value) for f in self.filters)
        return self.parts([f for f in listed(self.path, self.pattern) if keep(f)])


class MediaStream(_Reading, DataSourceStreamReader):
    """Files in order of (modified, path). An offset is the last one read."""

    def _files(self) -> list[tuple[int, str, MediaFile]]:
        return sorted((f.nanos, f.path, f) for f in listed(self.path, self.pattern))

    def initialOffset(self) -> dict:
        return {"nanos": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"nanos": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        after, upto = (start["nanos"], start["path"]), (end["nanos"], end["path"])
        return self.parts([f for nanos, path, f in self._files() if after < (nanos, path) <= upto])

    def commit(self, end: dict) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class _Writing:
    """Files of attempts, and their commit."""

    def __init__(self, options) -> None:
        self.path, self.batch = options["path"], options.get("batch") or uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, at = fs.FileSystem.from_uri(self.path)
        return store, at.rstrip("/")

    def write(self, iterator: Iterator) -> _Written:
        store, at = self._store()
        store.create_dir(f"{at}/_tasks", recursive=True)
        own, n = f"{at}/_tasks/{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(own) as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        if not n:
            store.delete_file(own)
        return _Written(own if n else None)

    def _commit(self, messages: list, batch: str) -> None:
        store, at = self._store()
        store.create_dir(at, recursive=True)
        mark, names = f"{at}/_batch-{batch}", [m.name for m in messages if m is not None and m.name]
        if store.get_file_info(mark).type == fs.FileType.NotFound:
            for k, own in enumerate(sorted(names)):
                store.move(own, f"{at}/{batch}-{k:05d}.json")
            with store.open_output_stream(mark) as out:
                out.write(str(len(names)).encode())
        else:  # this batch is there already
            self._drop(messages)

    def _drop(self, messages: list) -> None:
        store, _ = self._store()
        for m in messages:
            if m is not None and m.name and store.get_file_info(m.name).type == fs.FileType.File:
                store.delete_file(m.name)


class ResultsWriter(_Writing, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class ResultsStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"stream-{batchId:08d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class ResultsSink(DataSource):
    """Options: path, batch (the same for a run and its repetition)."""

    @classmethod
    def name(cls) -> str:
        return "temporis_results"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ResultsWriter:
        return ResultsWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> ResultsStreamWriter:
        return ResultsStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make both known to a session, and let filters reach sources."""
    spark.dataSource.register(MediaSource)
    spark.dataSource.register(ResultsSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

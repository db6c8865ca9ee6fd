"""Record files as a data source: whole texts by path, empty and unreadable files included, in batches and as a stream.

    files.register(spark)
    spark.read.format("record_files").option("names", "*.yaml,*.yml").load(folder)

Every file below the folder whose name matches is a row (path, size, modified, text, error); files and folders that begin
with a dot are skipped. A file of no bytes has an empty text, one that can't be read has an error instead, as has a
folder that isn't there. Partitions hold files of about partitionBytes together. Conditions on path and size, where Spark hands
them over (spark.sql.python.filterPushdown.enabled), leave files unread. As a stream, each file comes once, in the order of (modified, path).

The folder is one that Python reaches on the driver and on executors, by a path or a URI of pyarrow's file systems; for
other stores records.texts goes through Spark's own readers, which leave out files of no bytes.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

NAME = "record_files"
SCHEMA = "path string, size long, modified timestamp, text string, error string"
PARTITION_BYTES = 32 << 20

_HELD = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    GreaterThan: lambda have, want: have > want,
    GreaterThanOrEqual: lambda have, want: have >= want,
    LessThan: lambda have, want: have < want,
    LessThanOrEqual: lambda have, want: have <= want,
    StringStartsWith: lambda have, want: have.startswith(want),
    StringEndsWith: lambda have, want: have.endswith(want),
}


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    micros: int
    error: str | None = None


@dataclass
class Files(InputPartition):
    files: list[Found]


class _Folder:
    """What both readers share: the folder's files, their partitions and their rows."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.names = options["path"], [n.strip() for n in options.get("names", "*").split(",")]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def listed(self) -> list[Found]:
        """All files, by path."""
        store, root = self._at()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return [Found(self.root, 0, 0, "there is no such folder")]
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        shown = lambda p: not any(part.startswith(".") for part in p[len(root) :].split("/"))
        own = [i for i in infos if i.type == fs.FileType.File and shown(i.path) and any(fnmatch.fnmatchcase(posixpath.basename(i.path), n) for n in self.names)]
        return sorted((Found(i.path, i.size, (i.mtime_ns or 0) // 1000) for i in own), key=lambda f: f.path)

    def dealt(self, files: Iterable[Found]) -> list[Files]:
        parts, room = [Files([])], self.partition_bytes
        for f in files:
            if parts[-1].files and f.size > room:
                parts.append(Files([]))
                room = self.partition_bytes
            parts[-1].files.append(f)
            room -= f.size
        return parts

    def rows(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._at()
        for f in partition.files:
            text, error = None, f.error
            if error is None:
                try:
                    with store.open_input_stream(f.path) as stream:
                        text = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError) as wrong:
                    error = f"{type(wrong).__name__}: {wrong}"
            yield f.path, f.size, datetime.fromtimestamp(f.micros / 1e6, timezone.utc), text, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.conditions = _Folder(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if type(condition) in _HELD and condition.attribute in (("path",), ("size",)):
                self.conditions.append((type(condition), condition.attribute[0], condition.value))
            else:
                yield condition

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.dealt(f for f in self.folder.listed() if f.error or all(_HELD[kind](getattr(f, name), value) for kind, name, value in self.conditions))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the (modified, path) of the last file taken."""

    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"micros": -1, "path": ""}

    def latestOffset(self) -> dict:
        return max(({"micros": f.micros, "path": f.path} for f in self.folder.listed() if not f.error), key=lambda o: (o["micros"], o["path"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((o["micros"], o["path"]) for o in (start, end))
        new = [f for f in self.folder.listed() if not f.error and low < (f.micros, f.path) <= high]
        return self.folder.dealt(sorted(new, key=lambda f: (f.micros, f.path)))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take conditions on path and size."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)


def read(spark: SparkSession, path: str, names: str) -> DataFrame:
    """The files below path whose names match one of names ('*.yaml,*.yml'), with text or error."""
    register(spark)
    return spark.read.format(NAME).option("names", names).load(path)


def stream(spark: SparkSession, path: str, names: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("names", names).load(path)

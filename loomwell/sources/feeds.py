"""Truth files and the change feed as Python data sources, batch and streaming, with partitions, offsets and pushed filters.

``truth_files`` reads a folder of truth files: first line ``page_type;<type>``, second ``cle;statut;valeur``, then a field a line. A file is a
partition; a filter on ``page_type`` opens only the first line of files of other pages.

``change_feed`` reads an append-only log of rows with rising ids, in segments ``<first id, 20 digits>.jsonl`` of one JSON object
a line. Segments are partitions; their names tell which of them an id filter or a stream's offset can need. As a stream its offset is
the last id, so that a restart reads on where the checkpoint stands. A segment is complete once it has its name (write elsewhere, then rename).

Paths may be of any file system that pyarrow opens; readers list and read on executors and keep nothing on their disks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

TRUTH = "page_type string, key string, status string, value string, raw string, file string"
CHANGES = "id long, kind string, payload string"


def _open(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(path: str, ending: str) -> list[str]:
    from pyarrow import fs

    system, folder = _open(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(ending))


def _lines(path: str, name: str) -> Iterator[str]:
    import io

    system, _ = _open(path)
    with system.open_input_stream(name) as raw, io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8") as text:
        for line in text:
            yield line.rstrip("\r\n")


@dataclass
class FilePart(InputPartition):
    name: str
    low: int = 0
    high: int = 0


class TruthFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "truth_files"

    def schema(self) -> str:
        return TRUTH

    def reader(self, schema: Any) -> TruthReader:
        return TruthReader(self.options["path"])


class TruthReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.pages: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("page_type",):
                yield f
            else:
                self.pages = wanted if self.pages is None else self.pages & wanted

    def partitions(self) -> list[FilePart]:
        return [FilePart(name) for name in _names(self.path, ".csv")] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        if not partition.name:
            return
        lines = _lines(self.path, partition.name)
        head = next(lines, "").split(";")
        if len(head) < 2 or head[0] != "page_type":
            raise ValueError(f"{partition.name}: the first line must be page_type;<type>")
        page = head[1].strip()
        if self.pages is not None and page not in self.pages:
            return
        next(lines, None)
        for line in lines:
            if line.strip():
                key, status, value = (part.strip() for part in (line.split(";", 2) + ["", ""])[:3])
                yield page, key, status, value if status == "CONNU" else None, value, partition.name.rsplit("/", 1)[-1]


def segment_name(first: int) -> str:
    return f"{first:020d}.jsonl"


def _first(name: str) -> int:
    return int(name.rsplit("/", 1)[-1].removesuffix(".jsonl"))


def _segments(path: str, low: int, high: int | None) -> list[FilePart]:
    """Segments that may hold an id above ``low`` and not above ``high``: a segment ends before the next one's first id."""
    names = _names(path, ".jsonl")
    ends = [_first(n) - 1 for n in names[1:]] + [None] * bool(names)
    top = (1 << 63) - 1 if high is None else high
    return [FilePart(n, low, top) for n, end in zip(names, ends, strict=True) if _first(n) <= top and (end is None or end > low)]


def _rows(path: str, part: FilePart) -> Iterator[tuple]:
    for line in _lines(path, part.name):
        if line:
            row = json.loads(line)
            if part.low < row["id"] <= part.high:
                yield row["id"], row.get("kind"), json.dumps(row.get("payload"), ensure_ascii=False, sort_keys=True)


class ChangeFeed(DataSource):
    """Options: path; since (rows up to this id are left out)."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema: Any) -> ChangeReader:
        return ChangeReader(self.options["path"], int(self.options.get("since", 0)))

    def streamReader(self, schema: Any) -> ChangeStream:
        return ChangeStream(self.options["path"], int(self.options.get("since", 0)))


class ChangeReader(DataSourceReader):
    def __init__(self, path: str, since: int):
        self.path, self.low, self.high = path, since, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("id",):
                yield f
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value - 1)
            elif isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
                if isinstance(f, EqualTo):
                    self.low = max(self.low, f.value - 1)
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        return _segments(self.path, self.low, self.high) or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        if partition.name:
            yield from _rows(self.path, partition)


class ChangeStream(DataSourceStreamReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return {"id": self.since}

    def latestOffset(self) -> dict:
        """The last id of the last segment; only that one is read."""
        last = self.since
        for name in _names(self.path, ".jsonl")[-1:]:
            for line in _lines(self.path, name):
                if line:
                    last = max(last, json.loads(line)["id"])
        return {"id": last}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return _segments(self.path, start["id"], end["id"])

    def read(self, partition: FilePart) -> Iterator[tuple]:
        yield from _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the feed keeps its segments."""


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TruthFiles, ChangeFeed):
        spark.dataSource.register(source)

"""Shards of a corpus: appended small, compacted by size tiers, committed by manifest.

An arrival becomes small immutable files, one per task. Compaction takes runs of shards of
one size tier (sizes within a factor of ``FAN``), in the order in which they came, and merges
each into one file of about the target size; a merge is a job with one output file that reads
just its run, and several merges go at once. Nothing is changed in place. A version of the
corpus is a manifest file that lists its shards. It is written under a temporary name and
renamed, after its number was claimed by an exclusive create, so a reader sees a whole
version or the one before. Of two writers of a version one comes second; it reads the newer version and
commits its own change on top of it, unless shards that it merged are gone. A claim holds for ``LEASE``
seconds; a later one may be made then, so a writer that died between claim and rename blocks nobody
for longer. The lease has to be longer than the writing of one manifest takes. Older versions stay readable, and files of running
writers untouched, for ``keep_seconds``; ``vacuum`` deletes what no version that is kept lists.

The driver holds one entry of about 200 bytes per shard (0.2 MB per TB at the target size).

Defined cases: an empty arrival commits a version without new shards; an empty store has
version 0 and reads as an empty frame of the store's schema; nulls, repeated rows, empty
and long texts and extra columns go through as they are; a shard of more than half the target
is left alone, so one of any size is never rewritten for a few rows; columns of any
name go through; of shards of equal age the path decides their order.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FAN = 4
#: Seconds for which older versions stay, and for which a claim holds.
KEEP_SECONDS, LEASE = 86_400.0, 300.0
#: Merges that run at once.
AT_ONCE = 8


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    since: int


def tier(size: int, target: int = TARGET_BYTES) -> int:
    """0 for full shards, then 1, 2, ... for each factor of FAN below half the target."""
    k, edge = 0, target // 2
    while size < edge:
        k, edge = k + 1, edge // FAN
    return k


def plan(shards: list[Shard], target: int = TARGET_BYTES, last: bool = False) -> list[list[Shard]]:
    """Runs to merge: FAN or more shards of one tier (two, if ``last``), each run up to about the target."""
    runs: list[list[Shard]] = []
    groups: dict[int, list[Shard]] = {}
    for shard in sorted(shards, key=lambda s: (s.since, s.path)):
        if k := tier(shard.bytes, target):
            groups.setdefault(0 if last else k, []).append(shard)
    for group in groups.values():
        run: list[Shard] = []
        open_runs: list[list[Shard]] = []
        for shard in group:
            run.append(shard)
            if sum(s.bytes for s in run) >= target:
                open_runs.append(run)
                run = []
        open_runs += [run] * bool(run)
        runs += [r for r in open_runs if len(r) >= (2 if last else FAN) or len(r) > 1 and sum(s.bytes for s in r) >= target]
    return runs


class Conflict(Exception):
    """Another writer was first."""


class Store:
    """A versioned set of shards under one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keep_seconds: float = KEEP_SECONDS, lease: float = LEASE):
        self.spark, self.root, self.schema, self.keep_seconds, self.lease = spark, root.rstrip("/"), schema, keep_seconds, lease
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, pattern: str) -> list[tuple[str, float]]:
        """Names and ages in seconds of the files that match."""
        found = self.fs.globStatus(self._path(pattern))
        return sorted((s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in found)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max((int(name[9:-5]) for name, _ in self._names("manifest-*.json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifest-{version:08d}.json"))
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [Shard(**json.loads(line)) for line in lines.splitlines() if line]

    def _claim(self, version: int) -> str:
        """Claim a version for this writer; Conflict if another holds it."""
        if self.fs.exists(self._path(f"manifest-{version:08d}.json")):
            raise Conflict(f"version {version} exists")
        claims = self._names(f"claim-{version:08d}-*")
        if claims and min(age for _, age in claims) < self.lease:
            raise Conflict(f"a claim on version {version} exists")
        name = f"claim-{version:08d}-{len(claims):04d}"
        try:
            self.fs.create(self._path(name), False).close()
        except Py4JJavaError as error:
            raise Conflict(f"claim {name} exists") from error
        return name

    def commit(self, shards: list[Shard], version: int) -> int:
        """Make ``shards`` the given version; Conflict if another writer has it or holds its claim."""
        claim = self._claim(version)
        temporary = self._path(f"tmp-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in shards), "utf-8"))
        out.close()
        name = f"manifest-{version:08d}.json"
        last = self._names(f"claim-{version:08d}-*")[-1]
        if last[0] != claim or last[1] >= self.lease or self.fs.exists(self._path(name)):
            self.fs.delete(temporary, False)
            raise Conflict(f"the claim on version {version} is over")
        if not self.fs.rename(temporary, self._path(name)):
            raise OSError(f"version {version} could not be committed")
        return version

    def change(self, gone: set[str], new: list[Shard], tries: int = 60) -> int:
        """Commit the newest version without the shards ``gone`` and with ``new``, on top of whatever others commit."""
        for attempt in range(tries):
            version = self.version()
            now = self.manifest(version)
            if not gone <= {s.path for s in now}:
                raise Conflict("shards to be replaced are gone")
            new = [Shard(s.path, s.bytes, s.rows, version + 1) for s in new]
            try:
                return self.commit([s for s in now if s.path not in gone] + new, version + 1)
            except Conflict:
                time.sleep(min(self.lease, 0.05 * (attempt + 1)))
        raise Conflict(f"no turn in {tries} tries")

    def _files(self, folder: str) -> list[tuple[str, int]]:
        found = self.fs.globStatus(self._path(f"{folder}/*.parquet"))
        return sorted((s.getPath().toString(), s.getLen()) for s in found)

    def append(self, rows: DataFrame) -> int:
        """Write an arrival as one small shard per task and commit it."""
        folder = f"arrival-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        sizes = dict(self._files(folder))
        # one row per new shard; the files' names tell them apart
        counted = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        rows_of = {row["name"]: row["count"] for row in counted}
        return self.change(set(), [Shard(path, size, n, 0) for path, size in sizes.items() if (n := rows_of.get(path.rpartition("/")[2], 0))])

    def _merge(self, run: list[Shard]) -> Shard:
        folder = f"merged-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in run])
        rows.coalesce(1).write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        ((path, size),) = self._files(folder)
        return Shard(path, size, sum(s.rows for s in run), 0)

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merge tier by tier until no run is left, each round one version.

        Leftovers that fill no run are merged with each other at the end, over all tiers.
        """
        for last in (False, True):
            while runs := plan(self.manifest(), target, last):
                with ThreadPoolExecutor(AT_ONCE) as pool:
                    merged = list(pool.map(self._merge, runs))
                self.change({s.path for run in runs for s in run}, merged)
                self.vacuum()
                if last:
                    break
        return self.version()

    def vacuum(self) -> None:
        """Delete versions older than ``keep_seconds`` but the newest, then old files that no version lists."""
        newest = self.version()
        for name, age in self._names("manifest-*.json"):
            if int(name[9:-5]) < newest and age >= self.keep_seconds:
                self.fs.delete(self._path(name), False)
        versions = [int(name[9:-5]) for name, _ in self._names("manifest-*.json")]
        kept = {s.path for version in versions for s in self.manifest(version)}
        for status in self.fs.globStatus(self._path("*-*/*.parquet")):
            age = time.time() - status.getModificationTime() / 1000
            if status.getPath().toString() not in kept and age >= self.keep_seconds:
                self.fs.delete(status.getPath(), False)
        for name, age in self._names("claim-*") + self._names("tmp-*"):
            over = name.startswith("tmp-") or int(name[6:14]) <= newest
            if over and age >= max(self.keep_seconds, self.lease):
                self.fs.delete(self._path(name), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from exactly the shards that it lists."""
        paths = [s.path for s in self.manifest(version)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


def shard_corpus(docs: DataFrame, root: str, target: int = TARGET_BYTES, arrivals: int = 1, keep_seconds: float = KEEP_SECONDS) -> Store:
    """Append ``docs`` in some arrivals, dealt by a hash of the row, and compact after each."""
    store = Store(docs.sparkSession, root, docs.schema, keep_seconds)
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(part == i) if arrivals > 1 else docs)
        store.compact(target)
    return store


def digests(rows: DataFrame) -> DataFrame:
    """What the query reports of each document in the committed shards."""
    text = F.col("text")
    return rows.select("doc_id", "lang", "source", F.length(text).cast("long").alias("n_text"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_text, sha256(text) AS text_sha256 FROM documents
"""

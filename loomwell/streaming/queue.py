"""The processing queue as Structured Streaming: states, retries, idempotent delivery."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwell.operators.lifecycle import MOST_TRIES, check
from loomwell.operators.merge import newest


#: Where a person's save leads next, from where a record stands.
TO_SAVED = {
    "EN_ATTENTE_IA": "REVISION_MANUELLE_REQUISE", "ECHEC_TRAITEMENT": "REVISION_MANUELLE_REQUISE", "REVISION_MANUELLE_REQUISE": "VALIDE",
    "TRAITE_IA": "VALIDE", "A_REVISER": "VALIDE", "VALIDE": "PATIENTE_LIEE", "PATIENTE_LIEE": "ENREGISTRE",
}


def to_saved(at: str) -> list[str]:
    """The states that a save leads through."""
    path = []
    while at in TO_SAVED:
        at = TO_SAVED[at]
        path.append(at)
    return path


class UpsertSink:
    """A table of the newest row per key, written by ``foreachBatch``.

    Rows lie in ``buckets`` by a hash of their key; a batch rewrites only the buckets that it touches. A version is
    a manifest that names the folder of each bucket; its number is the batch's, so a batch that is sent
    again makes the same version again. A reader takes the newest manifest. Folders stay while one of the two newest versions names them.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str], buckets: int = 64):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        found = self.fs.globStatus(self._path("manifest-*.json")) or []
        return sorted(int(s.getPath().getName()[9:-5]) for s in found)

    def _manifest(self, version: int) -> dict[str, int]:
        stream = self.fs.open(self._path(f"manifest-{version}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _rows(self, folders: dict[str, int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/v={version}/bucket={bucket}" for bucket, version in sorted(folders.items())])

    def read(self) -> DataFrame | None:
        versions = self.versions()
        folders = self._manifest(versions[-1]) if versions else {}
        return self._rows(folders) if folders else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = [v for v in self.versions() if v < batch_id]
        folders = self._manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("bucket")
        touched = {str(r["bucket"]) for r in batch.select(bucket).distinct().collect()}  # one row per bucket at most
        old = {b: v for b, v in folders.items() if b in touched}
        rows = self._rows(old).unionByName(batch) if old else batch
        made = newest(rows, self.key, self.order).withColumn("bucket", bucket)
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={batch_id}")
        self._commit(folders | dict.fromkeys(touched, batch_id), batch_id)
        self._clean()

    def _commit(self, folders: dict[str, int], version: int) -> None:
        temporary, final = self._path(f"tmp-{uuid.uuid4().hex}"), self._path(f"manifest-{version}.json")
        out = self.fs.create(temporary, False)
        out.write(bytearray(json.dumps(folders), "utf-8"))
        out.close()
        self.fs.delete(final, False)  # of the same batch, if it was sent before
        if not self.fs.rename(temporary, final):
            raise OSError(f"version {version} could not be committed")

    def _clean(self) -> None:
        for version in self.versions()[:-2]:
            self.fs.delete(self._path(f"manifest-{version}.json"), False)
        kept = {(b, v) for version in self.versions() for b, v in self._manifest(version).items()}
        for status in self.fs.globStatus(self._path("v=*/bucket=*")) or []:
            path = status.getPath()
            if (path.getName()[7:], int(path.getParent().getName()[2:])) not in kept:
                self.fs.delete(path, True)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, exactly once per batch, and stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(stream: DataFrame, key: str, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Each content's first row; with a watermark, repeats are remembered only that long."""
    if watermark is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def work(stream: DataFrame, most_tries: int = MOST_TRIES) -> DataFrame:
    """(rec_id, state, tries) after each batch of outcomes (rec_id, seq, online, ok; maybe outages).

    Outcomes count in order of seq. ``online`` is the network at the start of a tick: offline, nothing begins. Being offline at its end is an outage. A failure goes back to the
    queue until the tries are used up; then a person is asked. ``outages`` counts the outages during the
    work: with one, work that was finished locally has failed all the same. After a person's ``saved``
    outcome the sync leg goes on: synced if it is ok, else failed until the next outcome, which finds it saved again. Every step is
    checked against the table of allowed transitions. :mod:`loomwell.streaming.worker` has leases and timed retries.
    """
    counted, legs = "outages" in stream.columns, "saved" in stream.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, at = state.get if state.exists else (0, "EN_ATTENTE_IA")
        rows = pd.concat(list(batches)).sort_values("seq")
        for row in rows.itertuples():
            ok = row.ok and not (counted and row.outages)
            if not row.online:
                continue
            path = []
            if legs and row.saved:
                path = to_saved(at)
            elif at in ("ENREGISTRE", "ECHEC_SYNC"):
                path = ["ENREGISTRE"] * (at == "ECHEC_SYNC") + ["SYNCHRONISE" if ok else "ECHEC_SYNC"]
            elif at in ("EN_ATTENTE_IA", "ECHEC_TRAITEMENT"):
                tries += not ok
                path = ["EN_ATTENTE_IA"] * (at == "ECHEC_TRAITEMENT") + (["TRAITE_IA"] if ok else ["ECHEC_TRAITEMENT"] + ["REVISION_MANUELLE_REQUISE"] * (tries >= most_tries))
            for to in path:
                at = check(at, to)
        state.update((tries, at))
        yield pd.DataFrame({"rec_id": [key[0]], "state": [at], "tries": [tries]})

    return stream.groupBy("rec_id").applyInPandasWithState(step, "rec_id long, state string, tries int", "tries int, state string", "update", GroupStateTimeout.NoTimeout)


def notify(states: DataFrame, told: DataFrame) -> DataFrame:
    """(rec_id, state): records whose state differs from the one that was told last, for a ``foreachBatch`` side output."""
    before = told.select("rec_id", F.col("state").alias("_told"))
    return states.join(before, "rec_id", "left").where(~F.col("state").eqNullSafe(F.col("_told"))).select("rec_id", "state")


def windowed_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window with late data bounded by a watermark (an extra of this engine)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"))

"""What the corpus operators share: shared-folder tables and small column helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions that have none set, by application.
_local_roots: dict[str, str] = {}
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode (tests) may leave it unset; it then gets a
    temporary folder, which is deleted when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="loomwell-")
            atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
        root = "file://" + _local_roots[app]
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/loomwell/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, narrow: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the copy
    outlives any executor. Returns the frame and its folder.

    ``narrow``: rows of a few numbers, which are written by four tasks per core at most, so that
    steps over small tables don't pay for a file per shuffle partition.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`materialise` that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with little to do does
    seldom; large steps in a row would keep all their shuffle files on the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Name of the column that tells apart texts under one id while rows are dropped.
TEXT_KEY = "loomwell_text_key"


def text_key(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def without(docs: DataFrame, dropped: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, text) isn't in ``dropped``; of rows with equal id and text one stays.

    ``dropped`` and ``marks`` (all rows) have doc_id and TEXT_KEY. Up to BROADCAST_IDS dropped rows (16
    bytes each) are broadcast, so that texts stay where they are; more are joined by a shuffle.
    """
    repeated = marks.groupBy("doc_id", TEXT_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id", TEXT_KEY)
    repeated, _ = materialise(repeated, "repeated", narrow=True)
    rows = docs.withColumn(TEXT_KEY, text_key(text_col))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnRenamed("doc_id", id_col)
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_IDS else right.hint("merge"), [id_col, TEXT_KEY], how).select(*rows.columns)

    rest = joined(rows, dropped, "left_anti")
    if not repeated.isEmpty():
        once = joined(rest, repeated, "left_semi").dropDuplicates([id_col, TEXT_KEY])
        rest = joined(rest, repeated, "left_anti").unionByName(once)
    return rest.drop(TEXT_KEY)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that long texts fit in a worker.

    Plans read this setting when they run, so it stays set in the session for the frames returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(1 << 26)).rstrip("b")) > most:
        spark.conf.set(key, str(most))

"""Tables between the steps of an iteration: written to the shared folder and read back, so that lineage is cut.

The folder is the one in ``spark.checkpoint.dir``. Only a session in local mode may leave it unset; it then gets
a temporary folder that is deleted when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomwell-steps-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table of its own: it outlives executors, and plans over it stay short."""
    path = f"{root(df.sparkSession)}/loomwell/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

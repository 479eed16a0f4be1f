"""Cutting lineage through tables in the folder that all executors share.

`spark.checkpoint.dir` names that folder. Where it is unset (tests, local sessions) a folder of
this process is used; on a cluster an unset folder is an error, because a machine-local one would
be lost with its executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, or in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tesserine-")
    return _own[app]


def materialise(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: its plan starts at a table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tesserine/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove materialised tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path and path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone
            return

"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage and survives the loss of executors. The folder is
``spark.checkpoint.dir``; only a session that doesn't name one (a local run, a test) gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_USED: dict[str, SparkSession] = {}


def _drop_local() -> None:
    while _LOCAL:
        shutil.rmtree(_LOCAL.pop(), ignore_errors=True)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_used() -> None:
    """Delete what this application has written, if its session still answers."""
    while _USED:
        where, spark = _USED.popitem()
        try:
            _delete(spark, where)
        except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
            return


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one if the session is local and names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="findwell-"))
        atexit.register(_drop_local)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: one computation, no lineage, columnar and compressed."""
    spark = df.sparkSession
    mine = f"{shared_dir(spark)}/findwell/{spark.sparkContext.applicationId}"
    if mine not in _USED:
        if not _USED:
            atexit.register(_drop_used)
        _USED[mine] = spark
    path = f"{mine}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, what a query has shuffled is deleted when the query ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        if "/findwell/" in file:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])

"""Tables that a job writes for itself, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_known: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder that goes with the process, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of what `write` writes from the tables of `source`: written by the first of an application that asks, and again if it's gone."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _known or not exists(spark, _known[key]):
        path = fresh(spark, name)
        write(path)
        _known[key] = path
    return _known[key]


def _located(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, True)


def saved(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """`df` written as Parquet and read again."""
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

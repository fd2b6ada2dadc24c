"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, spark.checkpoint.dir. Where that is unset a local session (tests) takes a temporary folder of
    the machine; on a cluster it is an error, as executors would not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + _local()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local() -> str:
    made = tempfile.mkdtemp(prefix="temporis-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def saver(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table and reads it back."""

    def save(df: DataFrame, name: str) -> DataFrame:
        path = folder(spark, name)
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    return save


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that a saver wrote and that nothing will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

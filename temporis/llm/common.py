"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Without one a local session (tests) takes a temporary
    folder of the machine; on a cluster its absence is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="temporis-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def set_for(spark: SparkSession, **conf: str):
    """Session settings (dots as __) that hold inside the block; the caller's come back after it."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Shuffle files of the run that wrote it go with its end: no later job reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with set_for(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote and that nothing will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def replace(old: DataFrame | None, df: DataFrame, name: str) -> DataFrame:
    """materialize df, then drop the table that it replaces."""
    out = materialize(df, name)
    drop(old)
    return out


def trim() -> None:
    """Give a Python worker's freed memory back to the system: workers are reused, and what one stage held stays otherwise."""
    gc.collect()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
        ctypes.CDLL(libc).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(values: Column, chunk: int = 512) -> Column:
    """Running sums of an int array, in two levels so that a long array costs n * chunk rather than n squared."""
    zero = F.lit(0).cast("long")
    empty = F.expr("cast(array() as array<bigint>)")

    def run(array: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(zero.alias("acc"), empty.alias("out")),
            lambda s, x: F.struct((s["acc"] + x).alias("acc"), F.concat(s["out"], F.array(s["acc"] + x)).alias("out")),
        )

    n = F.size(values)
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / chunk).cast("int"))),
        lambda c: run(F.slice(values, c * chunk + 1, F.lit(chunk))),
    )
    ends = run(F.transform(parts, lambda p: p["acc"]))["out"]
    return F.flatten(F.zip_with(parts, ends, lambda p, e: F.transform(p["out"], lambda v: v + e - p["acc"])))


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as the session has cores, where a small file gives fewer: heavy work on few rows then
    uses them all. A table of that many files or more stays as it is read, without a shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if len(docs.inputFiles()) >= cores or docs.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return docs
    return docs.repartition(cores)


def held_out() -> Column:
    """Rows whose labels no model may learn from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int) -> DataFrame:
    """doc_id, text, label of the rows of at most limit labelled doc_ids outside the held-out fold, in a seeded order of doc_id.

    limit is a documented bound (classifiers may be fitted on a bounded sample), so the list of ids can be broadcast.
    A doc_id with several labels takes the largest; null labels and ids are left out. Rows that repeat a doc_id are to be
    made one by one_a_document, once their texts are small statistics.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def one_a_document(rows: DataFrame, column: str, *more: str) -> DataFrame:
    """One row of each doc_id, that of the smallest column: a sample bounded by ids is bounded by rows too."""
    return rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in more], F.min(column).alias(column))

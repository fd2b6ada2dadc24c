"""Vectors by content: what an encoder has seen is not encoded again, in this run or a later one.

A vector's key is the digest of what was encoded, with the encoder's name, so a renamed or repeated item is found again and a changed one is not. The cache is a
table by encoder and day in a folder that driver and executors share. A run joins the digests that it asks for with those that are there, encodes one item of each
digest that is missing, and adds those as new files; nothing is rewritten. What an encoder can't read isn't kept, so it is tried again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.operators import retrieval

SCHEMA = "digest string, embedding array<float>, encoder string, day date"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


class VectorCache:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("encoder", "day").parquet(self.path)

    def vectors(self, encoder: str) -> DataFrame:
        """digest, embedding of an encoder, each digest once; runs that met may have added one twice."""
        kept = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("encoder") == encoder)
        return kept.groupBy("digest").agg(F.max_by("embedding", F.struct("day", F.hash("embedding"))).alias("embedding"))

    def missing(self, rows: DataFrame, column: str, encoder: str) -> DataFrame:
        """digest, value: one item of each digest that the cache doesn't hold."""
        asked = rows.where(F.col(column).isNotNull()).groupBy(digest(F.col(column)).alias("digest")).agg(F.min(column).alias("value"))
        return asked.join(self.vectors(encoder).select("digest"), "digest", "left_anti")

    def fill(self, rows: DataFrame, column: str, encoder: str, encode: Callable, day: datetime.date | None = None) -> None:
        """Encode what is missing, and keep it."""
        done = retrieval.encode(self.missing(rows, column, encoder), encode, "value").where("status = 'ok'")
        day = day or datetime.date.today()
        kept = done.select("digest", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(encoder).alias("encoder"), F.lit(day).alias("day"))
        kept.write.mode("append").partitionBy("encoder", "day").parquet(self.path)

    def encoded(self, rows: DataFrame, column: str, encoder: str, encode: Callable, day: datetime.date | None = None) -> DataFrame:
        """rows with embedding and status: ok, or failed where the item is null or can't be read."""
        self.fill(rows, column, encoder, encode, day)
        both = rows.withColumn("_digest", digest(F.col(column))).join(self.vectors(encoder).withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")
        return both.withColumn("status", F.when(F.col("embedding").isNull(), "failed").otherwise("ok"))

    def evict(self, before: datetime.date) -> int:
        """Delete the days before one; how many folders went."""
        jvm = self.spark._jvm
        store = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [d for d in (store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/encoder=*/day=*")) or []) if d.getPath().getName().removeprefix("day=") < before.isoformat()]
        for d in old:
            store.delete(d.getPath(), True)
        return len(old)

"""What both vector searches share: clean vectors, blocks, and the merge of local results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(rows: DataFrame, zeros: bool, more: Column) -> DataFrame:
    """vec_id, v (array of double), is_query (more, null as false), row (a number of its own) of the rows whose vectors are not null or
    empty and hold only finite numbers.

    zeros: whether vectors of zero length in the geometric sense stay. A null vec_id takes no part. Numbers of rows hold
    only once this is written as a table.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.select("vec_id", v.alias("v"), F.coalesce(more, F.lit(False)).alias("is_query"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~F.exists("v", bad))
    out = out if zeros else out.where(F.exists("v", lambda x: x != 0))
    return out.withColumn("row", F.monotonically_increasing_id())


def spread(key: Column, n: Column) -> Column:
    """A block number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(5), key), n).cast("int")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query row, ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of_arrays(found: DataFrame, k: int) -> DataFrame:
    """As best, where a row has a query's results in one cell as arrays ids and scores: one row goes through the shuffle a cell."""
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((F.lit(0.0) - x["scores"]).alias("below"), x["ids"].alias("vec_id")))
    merged = found.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("first"))
    ranked = merged.select("query_id", F.posexplode("first").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (F.lit(0.0) - F.col("x.below")).alias("score"))

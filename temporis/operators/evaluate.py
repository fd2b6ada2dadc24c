"""Evaluation: shards, scores, accuracy, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard(items: DataFrame, order: list[str], n: int, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """items with shard, in contiguous parts of len div n + 1 rows of a stated order.

    Rows are dealt to partitions by ranges of the order and numbered in each; the partitions' counts, a row each, tell where
    a partition begins. save(df, name) writes the numbered rows, so that both steps see the same ranges. The literal
    slices of the reference; on a cluster repartition() deals work more evenly.
    """
    part = F.spark_partition_id()
    dealt = items.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", part)
    inner = Window.partitionBy("_part").orderBy(*order)
    numbered = save(dealt.withColumn("_at", F.row_number().over(inner).cast("long")), "shard-rows")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = counts.select("_part", before.alias("_before"))
    total = numbered.count()
    place = F.col("_before") + F.col("_at") - 1
    return numbered.join(F.broadcast(starts), "_part").withColumn("shard", F.floor(place / (total // n + 1)).cast("int")).drop("_part", "_at", "_before")


def score(answer: Column, gold: Column) -> Column:
    """Whether the first letter of the answer is the gold letter; an empty answer is wrong."""
    return F.coalesce(F.substring(answer, 1, 1) == gold, F.lit(False))


def accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("accuracy"))


def hours_left(elapsed_s: Column, processed: Column, total: Column) -> Column:
    return F.when(processed > 0, elapsed_s / processed * (total - processed) / 3600)


def summary(turns: DataFrame) -> DataFrame:
    """conv_id, rounds, messages, longest: the figures a finished conversation shows."""
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("rounds"), F.count("*").alias("messages"), F.max(F.length("text")).alias("longest"))


def last_user_message(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def joined_turns(turns: DataFrame, mark: str = "\n") -> DataFrame:
    """conv_id, transcript: role and text of the turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), mark).alias("transcript"))


def neighbours(clips: DataFrame, last: str = "last_no") -> DataFrame:
    """The clip before, the clip itself and the one after, within 0 and the last clip; each once."""
    near = F.filter(F.array(F.col("clip_no") - 1, F.col("clip_no"), F.col("clip_no") + 1), lambda x: (x >= 0) & (x <= F.col(last)))
    return clips.select("video_id", F.explode(near).alias("clip_no")).distinct()


def merge_adjacent(clips: DataFrame, most: int = 2) -> DataFrame:
    """video_id, first_no, last_no: runs of adjacent clips, cut to parts of at most `most`."""
    order = Window.partitionBy("video_id").orderBy("clip_no")
    island = clips.select("video_id", "clip_no").distinct().withColumn("island", F.col("clip_no") - F.row_number().over(order))
    inner = Window.partitionBy("video_id", "island").orderBy("clip_no")
    part = island.withColumn("part", F.floor((F.row_number().over(inner) - 1) / most))
    return part.groupBy("video_id", "island", "part").agg(F.min("clip_no").alias("first_no"), F.max("clip_no").alias("last_no")).drop("island", "part")

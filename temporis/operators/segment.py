"""Temporal segmentation: clip grids, membership, completeness, and plans of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_grid(videos: DataFrame, seconds: float = 10, clamp: bool = True) -> DataFrame:
    """videos (with duration) -> a row for each clip: clip_no, start_s, end_s (at most the duration, if clamped)."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    out = videos.where("duration > 0").withColumn("clip_no", F.explode(F.sequence(F.lit(0), n - 1)))
    end = (F.col("clip_no") + 1) * float(seconds)
    return out.withColumn("start_s", F.col("clip_no") * float(seconds)).withColumn("end_s", F.least(end, "duration") if clamp else end)


def clip_number(t: Column, seconds: float = 10) -> Column:
    """The clip of a time: intervals closed below, open above."""
    return F.floor(t / seconds).cast("int")


def in_clip(t: Column, clip_no: Column, seconds: float = 10) -> Column:
    """Closed membership: a time on a border is in both clips."""
    return (clip_no * seconds <= t) & (t <= clip_no * seconds + seconds)


def cut_needed(found: Column, expected: Column) -> Column:
    """Cutting is skipped if at most two of the expected clips are missing."""
    return ~(found >= expected - 2)


def complete(valid: Column, expected: Column) -> Column:
    """At least two thirds, in whole numbers, of the clips are valid."""
    return valid >= F.floor(expected * 2 / 3)


def completeness(expected: DataFrame, clips: DataFrame, strict: bool = False) -> DataFrame:
    """video_id, expected, valid, is_complete; strict raises for a video that is not."""
    n = expected.groupBy("video_id").agg(F.count("*").alias("expected"))
    v = clips.groupBy("video_id").agg(F.count_if("is_valid").alias("valid"))
    out = n.join(v, "video_id", "left").na.fill(0, ["valid"]).withColumn("is_complete", complete(F.col("valid"), F.col("expected")))
    if strict:
        said = F.concat(F.lit("too few valid clips: "), F.col("video_id").cast("string"))
        out = out.withColumn("is_complete", F.when(F.col("is_complete"), True).otherwise(F.raise_error(said).cast("boolean")))
    return out


def missing_clips(expected: DataFrame, clips: DataFrame, least: int = 2) -> DataFrame:
    """Expected clips that are absent or don't open, of the videos that miss at least `least`."""
    opened = clips.where("is_valid").select("video_id", "clip_no")
    lost = expected.join(opened, ["video_id", "clip_no"], "left_anti")
    enough = lost.groupBy("video_id").count().where(F.col("count") >= least).select("video_id")
    return lost.join(enough, "video_id", "left_semi")


def stray_clips(expected: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips that no grid expects."""
    return clips.join(expected.select("video_id", "clip_no"), ["video_id", "clip_no"], "left_anti")

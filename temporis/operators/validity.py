"""Filters on readability, readiness and ranges; de-duplication; resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_video(opens_first: Column, opens_second: Column) -> Column:
    """A video counts if both decoders open it."""
    return opens_first & opens_second


def openable(frame_count: Column) -> Column:
    return F.coalesce(frame_count > 0, F.lit(False))


def of_tasks(rows: DataFrame, tasks: str | None) -> DataFrame:
    """Rows of a comma-separated list of tasks; all without one."""
    return rows if not tasks else rows.where(F.col("task").isin(tasks.split(",")))


def ready(questions: DataFrame, videos: DataFrame, frames: DataFrame, embeddings: DataFrame, fps: float) -> DataFrame:
    """Questions whose video exists, has at least duration * fps - 5 frames, and has embeddings."""
    counted = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    enough = videos.join(counted, "video_id").where(F.col("n") >= F.col("duration") * fps - 5).select("video_id")
    return questions.join(enough, "video_id", "left_semi").join(embeddings.select("video_id"), "video_id", "left_semi")


def page(rows: DataFrame, order: list[str], begin: int, end: int) -> DataFrame:
    """Rows begin to end - 1 of a stated order."""
    return rows.orderBy(*order).offset(begin).limit(max(0, end - begin))


def accepted_cache(clips: DataFrame, most_invalid: int = 3) -> DataFrame:
    """Videos whose cached embeddings are taken: fewer than most_invalid unreadable clips (3; 5 for frames)."""
    return clips.groupBy("video_id").agg(F.count_if(~F.col("is_valid")).alias("invalid")).withColumn("accepted", F.col("invalid") < most_invalid)


def subtitle_range(subtitles: DataFrame, begin: Column, end: Column, offset: Column | None = None) -> DataFrame:
    """Subtitles that start in the closed range (moved by an offset), with whole seconds, not moved back."""
    by = F.coalesce(offset, F.lit(0.0)) if offset is not None else F.lit(0.0)
    inside = F.col("start_s").between(begin + by, end + by)
    return subtitles.where(inside).withColumn("start_s", F.col("start_s").cast("long")).withColumn("end_s", F.col("end_s").cast("long"))


def shift_back(hits: DataFrame, offset: Column) -> DataFrame:
    """Retrieved subtitles in the item's own time."""
    by = F.coalesce(offset, F.lit(0.0))
    return hits.withColumn("start_s", F.col("start_s") - by).withColumn("end_s", F.col("end_s") - by)


def last_text_wins(subtitles: DataFrame) -> DataFrame:
    """Of subtitles of the same interval one: at the place of the first, with the text of the last."""
    return subtitles.groupBy("video_id", "start_s", "end_s").agg(F.min("seq").alias("seq"), F.max_by("text", "seq").alias("text"))


def distinct_calls(calls: DataFrame, compat: str = "fixed") -> DataFrame:
    """Calls without repeats of (conv_id, query, match_set), the first of each; literal keeps all, as the reference does."""
    if compat == "literal":
        return calls
    order = Window.partitionBy("conv_id", "query", "match_set").orderBy("turn", "call_no")
    return calls.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cached_for(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Cached answers whose (question, video_path) is among the questions."""
    return answers.join(questions.select("question", "video_path"), ["question", "video_path"], "left_semi")


def unprocessed(questions: DataFrame, answers: DataFrame, compat: str = "fixed") -> DataFrame:
    """Questions without an answer; literal tells them by the question's text alone."""
    keys = ["question"] if compat == "literal" else ["question", "video_path"]
    return questions.join(answers.select(*keys), keys, "left_anti")

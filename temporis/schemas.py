"""Declared schemas of the engine's tables, and the stand-ins for them that the driver's tables offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.session import table

VIDEOS = "video_id string, path string, duration double, fps double, width int, height int"
CLIPS = "video_id string, clip_no int, start_s double, end_s double, path string, is_valid boolean"
FRAMES = "video_id string, t_s double, path string, is_valid boolean"
SUBTITLES = "video_id string, seq int, start_s double, end_s double, text string"
CLIP_EMBEDDINGS = "video_id string, clip_no int, embedding array<float>"
SUBTITLE_EMBEDDINGS = "video_id string, seq int, embedding array<float>"
QUESTIONS = (
    "id string, video_id string, question string, question_wo_referring_query string, correct_choice int, answer string, "
    "options array<string>, position array<int>, topic_category string, question_category string, level string, task string, "
    "video_path string, subtitle_path string, duration_group int, view_count int, starting_timestamp_for_subtitles double, duration double"
)
MESSAGES = "conv_id string, turn int, role string, content array<struct<type string, text string, image_ref string>>"
TURNS = "conv_id long, turn long, role string, text string"
STEP_EVENTS = "conv_id long, seq long, type string, status string, tool string, attrs map<string,string>"
RESULTS = "item_id string, answer string, gold string, score boolean, rounds int"

#: The driver's tables hold no media. Events stand for timed frames and subtitles: user_id is the video, ts the time in it, run
#: a thousand times faster from the start of 2024; an event of type error is an unreadable frame.
LAPSE = 1e9


def seconds(ts: Column) -> Column:
    """Seconds in the stand-in video, whatever the session's time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return micros / F.lit(LAPSE)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_no, t_s, is_valid, kind, value, props."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_no"), seconds(F.col("ts")).alias("t_s"),
        (F.col("event_type") != "error").alias("is_valid"), F.col("event_type").alias("kind"), "value", "props",
    )


FRAMES_SQL = """frames AS (
  SELECT user_id AS video_id, event_id AS frame_no, (epoch_us(ts) - 1704067200000000) / 1e9 AS t_s,
         event_type <> 'error' AS is_valid, event_type AS kind, value, props FROM events
)"""


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, seq, start_s, end_s, text: frames of type view and click, each shown for 2 to 6 seconds."""
    return frames(spark, sf_dir).where(F.col("kind").isin("view", "click")).select(
        "video_id", F.col("frame_no").alias("seq"), F.col("t_s").alias("start_s"), (F.col("t_s") + 2 + F.col("frame_no") % 5).alias("end_s"), F.concat_ws(" ", "kind", "props").alias("text")
    )


SUBTITLES_SQL = (
    FRAMES_SQL
    + """, subtitles AS (
  SELECT video_id, frame_no AS seq, t_s AS start_s, t_s + 2 + frame_no % 5 AS end_s, kind || ' ' || props AS text FROM frames
  WHERE kind IN ('view', 'click')
)"""
)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, duration."""
    return frames(spark, sf_dir).groupBy("video_id").agg(F.max("t_s").alias("duration"))


VIDEOS_SQL = FRAMES_SQL + ", videos AS (SELECT video_id, max(t_s) AS duration FROM frames GROUP BY video_id)"


def clip_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id (label), clip_no (vec_id), embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("clip_no"), "embedding")

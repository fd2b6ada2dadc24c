"""Subtitle files: SRT blocks and JSON lists -> rows; flat strings for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.functions.text import without_font
from temporis.functions.timecode import parse_timecode

JSON_LINES = "array<struct<start:string,end:string,line:string>>"


def parse_srt(files: DataFrame, strict: bool = False) -> DataFrame:
    """files (video_id, content) -> video_id, seq, start_s, end_s, text, status.

    Blocks end at a blank line; line 2 is the range, later lines are the text. Blocks of fewer than three lines are dropped. One
    with a bad range is kept apart with status "malformed" (strict raises). Line ends may be CRLF.
    """
    content = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    blocks = files.select("video_id", F.posexplode(F.split(content, "\n\n")).alias("seq", "block"))
    lines = F.split(F.col("block"), "\n")
    rows = blocks.where((F.trim("block") != "") & (F.size(lines) >= 3)).withColumn("lines", lines)
    times = F.split(F.get("lines", F.lit(1)), " --> ")
    start, end = parse_timecode(F.get(times, F.lit(0))), parse_timecode(F.get(times, F.lit(1)))
    bad = start.isNull() | end.isNull()
    status = F.when(bad, F.raise_error(F.concat(F.lit("malformed subtitle block: "), F.col("block"))).cast("string") if strict else F.lit("malformed")).otherwise("ok")
    text = F.array_join(F.slice("lines", F.lit(3), F.size("lines")), " ")
    return rows.select("video_id", "seq", start.alias("start_s"), end.alias("end_s"), without_font(text).alias("text"), status.alias("status"))


def parse_json(files: DataFrame) -> DataFrame:
    """files (video_id, content: a JSON list of start, end, line) -> the same rows as parse_srt."""
    lines = files.select("video_id", F.posexplode(F.from_json("content", JSON_LINES)).alias("seq", "x"))
    start, end = parse_timecode(F.col("x.start")), parse_timecode(F.col("x.end"))
    status = F.when(start.isNull() | end.isNull(), "malformed").otherwise("ok")
    return lines.select("video_id", "seq", start.alias("start_s"), end.alias("end_s"), F.col("x.line").alias("text"), status.alias("status"))


def read(spark: SparkSession, srt: str | None = None, json: str | None = None, strict: bool = False) -> DataFrame:
    """Subtitles of the files under srt, and of those under json for videos that have no SRT file."""

    def files(path: str, suffix: str) -> DataFrame:
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
        return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, suffix, "").alias("video_id"), F.col("value").alias("content"))

    first = parse_srt(files(srt, r"\.srt$"), strict) if srt else None
    second = parse_json(files(json, r"_en\.json$")) if json else None
    if first is None or second is None:
        return second if first is None else first
    return first.unionByName(second.join(first.select("video_id").distinct(), "video_id", "left_anti"))


def flat(subtitles: DataFrame, mark: str = " ", trailing: bool = True) -> DataFrame:
    """video_id, subtitles: int(start)-int(end):text of all, in order; SRT puts a blank after each, JSON joins lines."""
    one = lambda s: F.concat(s["start_s"].cast("long").cast("string"), F.lit("-"), s["end_s"].cast("long").cast("string"), F.lit(":"), s["text"])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start_s", "end_s", "text")))
    joined: Column = F.array_join(F.transform(ordered, one), mark)
    return subtitles.groupBy("video_id").agg((F.concat(joined, F.lit(mark)) if trailing else joined).alias("subtitles"))

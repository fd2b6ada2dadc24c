"""Times: subtitle time codes, clip and frame names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("long")


def parse_timecode(text: Column) -> Column:
    """Seconds of HH:MM:SS,mmm; milliseconds are a whole number, so ",5" is 0.005. NULL where malformed."""
    parts = F.split(text, ":")
    rest = F.split(F.get(parts, F.lit(2)), ",")
    value = _number(F.get(parts, F.lit(0))) * 3600 + _number(F.get(parts, F.lit(1))) * 60 + _number(F.get(rest, F.lit(0))) + _number(F.get(rest, F.lit(1))) / F.lit(1000.0)
    return F.when((F.size(parts) == 3) & (F.size(rest) == 2), value)


def clock(seconds: Column, mark: str = "-") -> Column:
    """HH-MM-SS (or with another mark) of whole seconds."""
    whole = F.floor(seconds).cast("long")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(whole / 3600).cast("long")
    return F.concat_ws(mark, F.when(hours > 99, hours.cast("string")).otherwise(pad(hours)), pad(F.floor(whole % 3600 / 60).cast("long")), pad(whole % 60))


def clip_name(clip_no: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("clip_"), clip_no.cast("string"), F.lit("_"), clock(start), F.lit("_to_"), clock(end), F.lit(".mp4"))


def parse_clip_name(name: Column) -> Column:
    """struct(clip_no, start_s, end_s) of a clip's file name; NULL fields where it is none."""
    pattern = r"clip_(\d+)_(\d+)-(\d+)-(\d+)_to_(\d+)-(\d+)-(\d+)"
    part = lambda k: F.regexp_extract(name, pattern, k).try_cast("long")
    of = lambda k: (part(k) * 3600 + part(k + 1) * 60 + part(k + 2)).cast("double")
    return F.struct(part(1).alias("clip_no"), of(2).alias("start_s"), of(5).alias("end_s"))


def frame_name(seconds: Column) -> Column:
    return F.concat(F.lit("frame_"), F.format_string("%.3f", seconds), F.lit(".jpg"))


def parse_frame_name(name: Column) -> Column:
    return F.regexp_extract(name, r"frame_(\d+(?:\.\d+)?)\.\w+$", 1).try_cast("double")


def stem(path: Column, first_dot: bool = True) -> Column:
    """Base name up to its first dot, or without its last suffix."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.substring_index(base, ".", 1) if first_dot else F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def subtitle_path(video_path: Column, suffix: str = ".srt") -> Column:
    """The subtitle file that belongs to a video file."""
    return F.replace(F.replace(video_path, F.lit("videos"), F.lit("subtitles")), F.lit(".mp4"), F.lit(suffix))

"""Segmentation, sampling, interval and subtitle queries over the stand-ins that schemas.py describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis import schemas
from temporis.functions import numeric, text, timecode
from temporis.operators import evaluate, interval, sample, segment, validity
from temporis.registry import query
from temporis.schemas import FRAMES_SQL, SUBTITLES_SQL, VIDEOS_SQL
from temporis.session import table
from temporis.sources import subtitles as subs

#: How loudness is standardised by default.
AUDIO_MEAN, AUDIO_STD = 0.5, 0.5

_GRID = VIDEOS_SQL + """, grid AS (
  SELECT video_id, duration, CAST(unnest(range(CAST(ceil(duration / 10) AS BIGINT))) AS INTEGER) AS clip_no FROM videos WHERE duration > 0
)"""


def _hms(x: str) -> str:
    return f"printf('%02d-%02d-%02d', CAST(floor(({x}) / 3600) AS BIGINT), CAST(floor(floor({x}) % 3600 / 60) AS BIGINT), CAST(floor({x}) % 60 AS BIGINT))"


@query("seg1_clip_grid", f"WITH {_GRID} SELECT video_id, clip_no, clip_no * 10.0::DOUBLE AS start_s, round(least((clip_no + 1) * 10.0::DOUBLE, duration), 6) AS end_s FROM grid")
def seg_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = segment.clip_grid(schemas.videos(spark, sf_dir))
    return grid.select("video_id", "clip_no", "start_s", F.round("end_s", 6).alias("end_s"))


@query("seg2_clip_grid_open", f"WITH {_GRID} SELECT video_id, clip_no, (clip_no + 1) * 10.0::DOUBLE AS end_s FROM grid")
def seg_grid_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.clip_grid(schemas.videos(spark, sf_dir), clamp=False).select("video_id", "clip_no", "end_s")


@query("seg3_clip_names", f"WITH {_GRID} SELECT video_id, clip_no, 'clip_' || clip_no || '_' || {_hms('clip_no * 10')} || '_to_' || {_hms('clip_no * 10 + 10')} || '.mp4' AS name, clip_no * 10.0::DOUBLE AS parsed_start FROM grid")
def seg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = segment.clip_grid(schemas.videos(spark, sf_dir), clamp=False)
    named = grid.withColumn("name", timecode.clip_name(F.col("clip_no"), F.col("start_s"), F.col("end_s")))
    return named.select("video_id", F.col("clip_no"), "name", timecode.parse_clip_name(F.col("name"))["start_s"].alias("parsed_start"))


@query("seg4_clip_assign", f"WITH {FRAMES_SQL} SELECT frame_no, CAST(floor(t_s / 10) AS INTEGER) AS clip_no, floor(t_s / 10) * 10 <= t_s AND t_s <= floor(t_s / 10) * 10 + 10 AS inside FROM frames")
def seg_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segment.clip_number(F.col("t_s"))
    return schemas.frames(spark, sf_dir).select("frame_no", own.alias("clip_no"), segment.in_clip(F.col("t_s"), own).alias("inside"))


_CLIPS = _GRID + """, clips AS (
  SELECT video_id, CAST(floor(t_s / 10) AS INTEGER) AS clip_no, bool_or(is_valid) AS is_valid FROM frames GROUP BY ALL
), expected AS (SELECT video_id, clip_no FROM grid)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip is there if a frame of it is, and valid if one of them is readable."""
    rows = schemas.frames(spark, sf_dir).withColumn("clip_no", segment.clip_number(F.col("t_s")))
    return rows.groupBy("video_id", "clip_no").agg(F.bool_or("is_valid").alias("is_valid"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.clip_grid(schemas.videos(spark, sf_dir)).select("video_id", "clip_no")


@query("seg5_cut_needed", f"WITH {_CLIPS}, e AS (SELECT video_id, count(*) AS expected FROM expected GROUP BY 1), c AS (SELECT video_id, count(*) AS found FROM clips GROUP BY 1) SELECT e.video_id, e.expected, c.found, NOT c.found >= e.expected - 2 AS cut_needed FROM e JOIN c USING (video_id)")
def seg_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _expected(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("expected"))
    c = _clips(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("found"))
    return e.join(c, "video_id").withColumn("cut_needed", segment.cut_needed(F.col("found"), F.col("expected")))


@query("seg6_clip_complete", f"WITH {_CLIPS}, e AS (SELECT video_id, count(*) AS expected FROM expected GROUP BY 1), c AS (SELECT video_id, count_if(is_valid) AS valid FROM clips GROUP BY 1) SELECT e.video_id, e.expected, CAST(coalesce(c.valid, 0) AS BIGINT) AS valid, coalesce(c.valid, 0) >= 2 * e.expected // 3 AS is_complete FROM e LEFT JOIN c USING (video_id)")
def seg_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.completeness(_expected(spark, sf_dir), _clips(spark, sf_dir))


@query("seg7_clip_missing", f"WITH {_CLIPS}, lost AS (SELECT e.* FROM expected e ANTI JOIN clips c ON e.video_id = c.video_id AND e.clip_no = c.clip_no AND c.is_valid) SELECT video_id, clip_no FROM lost WHERE video_id IN (SELECT video_id FROM lost GROUP BY 1 HAVING count(*) > 1)")
def seg_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.missing_clips(_expected(spark, sf_dir), _clips(spark, sf_dir))


@query("set4_clip_strays", f"WITH {_CLIPS} SELECT c.video_id, c.clip_no FROM clips c ANTI JOIN (SELECT * FROM expected WHERE clip_no % 3 <> 0) e ON e.video_id = c.video_id AND e.clip_no = c.clip_no")
def set_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.stray_clips(_expected(spark, sf_dir).where("clip_no % 3 <> 0"), _clips(spark, sf_dir)).select("video_id", "clip_no")


_ASK = FRAMES_SQL + """, asks AS (
  SELECT video_id, frame_no AS ask, t_s AS b, t_s + frame_no % 4 * 0.7 AS e FROM frames WHERE kind = 'click'
), wide AS (SELECT *, CASE WHEN e - b < 1 THEN greatest(b - 0.5, 0) ELSE b END AS wb, CASE WHEN e - b < 1 THEN e + 0.5 ELSE e END AS we FROM asks
), points AS (SELECT video_id, ask, unnest(range(CAST(floor((we - wb) * 2) AS BIGINT))) AS i, wb FROM wide
), pts AS (SELECT video_id, ask, i, wb + i * 0.5 AS t FROM points)"""


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.frames(spark, sf_dir).where("kind = 'click'").select("video_id", F.col("frame_no").alias("ask"), F.col("t_s").alias("b"), (F.col("t_s") + F.col("frame_no") % 4 * F.lit(0.7)).alias("e"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asks(spark, sf_dir).select("video_id", "ask", F.posexplode(sample.interval_points(F.col("b"), F.col("e"))).alias("i", "t"))


@query("smp1_interval_points", f"WITH {_ASK} SELECT video_id, ask, CAST(i AS INTEGER) AS i, round(t, 6) AS t FROM pts")
def smp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("video_id", "ask", "i", F.round("t", 6).alias("t"))


@query("smp2_clip_points", f"WITH {_CLIPS} SELECT video_id, clip_no, round(clip_no * 10.0::DOUBLE + i * 0.5, 6) AS t FROM clips, range(20) r(i) WHERE is_valid")
def smp_clip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).where("is_valid").select("video_id", "clip_no", F.explode(sample.clip_points(F.col("clip_no"))).alias("t")).withColumn("t", F.round("t", 6))


@query("smp3_source_frame", f"WITH {FRAMES_SQL} SELECT frame_no, CAST(round_even(frame_no * 0.5 * 5.0::DOUBLE, 0) AS BIGINT) AS source FROM frames")
def smp_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.frames(spark, sf_dir).select("frame_no", numeric.source_frame(F.col("frame_no") * F.lit(0.5), F.lit(5.0)).alias("source"))


_NEAR = _ASK + """, j AS (
  SELECT p.video_id, p.ask, p.i, p.t, f.frame_no, f.is_valid, row_number() OVER (PARTITION BY p.video_id, p.ask, p.i ORDER BY abs(f.t_s - p.t), f.t_s, f.frame_no) AS n
  FROM pts p JOIN frames f ON p.video_id = f.video_id
), near AS (SELECT * FROM j WHERE n = 1)"""


@query("smp4_nearest_frame", f"WITH {_NEAR} SELECT video_id, ask, CAST(i AS INTEGER) AS i, frame_no FROM near")
def smp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sample.nearest_frames(_points(spark, sf_dir), schemas.frames(spark, sf_dir).select("video_id", "t_s", "frame_no", "is_valid"))
    return near.select("video_id", "ask", "i", F.col("nearest.frame_no").alias("frame_no"))


@query("smp5_readable_frames", f"WITH {_NEAR} SELECT video_id, ask, count(*) AS n FROM near WHERE is_valid GROUP BY 1, 2")
def smp_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sample.readable_frames(_points(spark, sf_dir), schemas.frames(spark, sf_dir).select("video_id", "t_s", "frame_no", "is_valid"))
    return near.groupBy("video_id", "ask").agg(F.count("*").alias("n"))


_LISTS = FRAMES_SQL + ", lists AS (SELECT video_id, list(frame_no ORDER BY t_s, frame_no) AS f, len(list(frame_no)) AS n FROM frames WHERE is_valid GROUP BY 1)"


def _thinned(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    kept = sample.thinned(schemas.frames(spark, sf_dir).where("is_valid"), ["video_id"], ["t_s", "frame_no"], how)
    return kept.select("video_id", F.posexplode("frames").alias("pos", "f")).select("video_id", "pos", "f.frame_no")


@query("smp6_stride", f"WITH {_LISTS} SELECT video_id, CAST(p AS INTEGER) AS pos, f[p * greatest(1, n // 32) + 1] AS frame_no FROM lists, range(32) r(p) WHERE p * greatest(1, n // 32) < n")
def smp_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thinned(spark, sf_dir, "stride")


@query("smp7_uniform", f"WITH {_LISTS} SELECT video_id, CAST(p AS INTEGER) AS pos, CASE WHEN n > 32 THEN f[CAST(floor(p * (n / 32.0::DOUBLE)) AS BIGINT) + 1] ELSE f[p + 1] END AS frame_no FROM lists, range(32) r(p) WHERE p < n")
def smp_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thinned(spark, sf_dir, "uniform")


@query("smp8_repeat", f"WITH {_LISTS}, few AS (SELECT video_id, f[1:CAST(1 + video_id % 9 AS BIGINT)] AS f FROM lists), m AS (SELECT *, len(f) AS n FROM few) SELECT video_id, CAST(p AS INTEGER) AS pos, f[CAST(floor(p * (n / 10.0::DOUBLE)) AS BIGINT) + 1] AS frame_no FROM m, range(10) r(p)")
def smp_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = sample.placed(schemas.frames(spark, sf_dir).where("is_valid"), ["video_id"], ["t_s", "frame_no"], "place").where(F.col("place") <= F.col("video_id") % 9)
    filled = sample.thinned(few, ["video_id"], ["t_s", "frame_no"], least=sample.MIN_FRAMES)
    return filled.select("video_id", F.posexplode("frames").alias("pos", "f")).select("video_id", "pos", "f.frame_no")


@query("smp9_required", f"WITH {_LISTS} SELECT video_id, CAST(n AS INTEGER) AS n FROM lists WHERE n > 0")
def smp_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sample.thinned(schemas.frames(spark, sf_dir).where("is_valid"), ["video_id"], ["t_s", "frame_no"])
    held = sample.required(F.transform("frames", lambda x: x["t_s"]))
    return counts.select("video_id", F.when(F.size(held) > 0, F.col("n")).alias("n"))


@query("smp10_fixed_rate", f"WITH {FRAMES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_s, frame_no) - 1 AS pos FROM frames) SELECT video_id, frame_no, CAST(pos // 12 AS INTEGER) AS ordinal FROM o WHERE pos % 12 = 0")
def smp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.fixed_rate(schemas.frames(spark, sf_dir), 25.0, 2.0).select("video_id", "frame_no", "ordinal")


@query("flt1_valid_video", f"WITH {FRAMES_SQL} SELECT video_id, count_if(is_valid) > 3 AND count(*) > 5 AS is_valid FROM frames GROUP BY 1")
def flt_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = schemas.frames(spark, sf_dir).groupBy("video_id").agg((F.count_if("is_valid") > 3).alias("a"), (F.count("*") > 5).alias("b"))
    return counted.select("video_id", validity.valid_video(F.col("a"), F.col("b")).alias("is_valid"))


@query("flt2_valid_frame", f"WITH {FRAMES_SQL} SELECT video_id, CAST(count_if(is_valid) AS BIGINT) AS valid, CAST(count_if(NOT is_valid) AS BIGINT) AS invalid FROM frames GROUP BY 1")
def flt_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.frames(spark, sf_dir).groupBy("video_id").agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


@query("flt3_openable", f"WITH {FRAMES_SQL}, u AS (SELECT video_id, count_if(kind = 'error') AS n FROM frames GROUP BY 1) SELECT video_id, n > 0 AS openable FROM u")
def flt_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = schemas.frames(spark, sf_dir).groupBy("video_id").agg(F.count_if(F.col("kind") == "error").alias("n"))
    return n.select("video_id", validity.openable(F.col("n")).alias("openable"))


@query("flt4_tasks", "SELECT event_id, event_type AS task FROM events WHERE event_type IN ('view', 'click')")
def flt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.of_tasks(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task")), "view,click")


@query("flt5_ready", f"WITH {VIDEOS_SQL}, c AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) SELECT b.item_id FROM benchmark b WHERE b.item_id IN (SELECT v.video_id FROM videos v JOIN c USING (video_id) WHERE c.n >= v.duration * 0.02::DOUBLE - 5) AND b.item_id % 10 IN (SELECT label FROM embeddings)")
def flt_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("video_id"))
    have = table(spark, sf_dir, "embeddings").select("label").distinct()
    vectors = questions.join(have, F.expr("video_id % 10 = label")).select("video_id")
    return validity.ready(questions, schemas.videos(spark, sf_dir), schemas.frames(spark, sf_dir), vectors, 0.02).select("item_id")


@query("flt6_page", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40 OFFSET 20")
def flt_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.page(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 20, 60)


@query("flt7_distinct_videos", "SELECT DISTINCT user_id AS video_id FROM events ORDER BY 1")
def flt_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.frames(spark, sf_dir).select("video_id").distinct().orderBy("video_id")


@query("flt8_cache_accepted", f"WITH {_CLIPS} SELECT video_id, CAST(count_if(NOT is_valid) AS BIGINT) AS invalid, count_if(NOT is_valid) < 3 AS accepted FROM clips GROUP BY 1")
def flt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.accepted_cache(_clips(spark, sf_dir))


@query("flt9_subtitle_range", f"WITH {SUBTITLES_SQL} SELECT video_id, seq, CAST(floor(start_s) AS BIGINT) AS start_s, CAST(floor(end_s) AS BIGINT) AS end_s, text FROM subtitles WHERE start_s BETWEEN 300 AND 900")
def flt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.subtitle_range(schemas.subtitles(spark, sf_dir), F.lit(300.0), F.lit(900.0))


@query("flt10_subtitle_offset", f"WITH {SUBTITLES_SQL} SELECT video_id, seq, round(start_s - 12.5, 5) AS start_s FROM subtitles WHERE start_s BETWEEN 312.5 AND 912.5")
def flt_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schemas.subtitles(spark, sf_dir)
    inside = rows.where(F.col("start_s").between(300 + 12.5, 900 + 12.5))
    return validity.shift_back(inside, F.lit(12.5)).select("video_id", "seq", F.round("start_s", 5).alias("start_s"))


_OVER = SUBTITLES_SQL + ", shown AS (SELECT video_id, frame_no AS shot, t_s AS start_s, t_s + 5 AS end_s FROM frames WHERE kind = 'purchase')"


@query("join2_subtitle_overlap", f"WITH {_OVER} SELECT s.video_id, s.seq, f.shot FROM subtitles s JOIN shown f ON s.video_id = f.video_id AND s.start_s <= f.end_s AND f.start_s <= s.end_s")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = schemas.frames(spark, sf_dir).where("kind = 'purchase'").select("video_id", F.col("frame_no").alias("shot"), F.col("t_s").alias("start_s"), (F.col("t_s") + 5).alias("end_s"))
    return interval.overlap_join(schemas.subtitles(spark, sf_dir), shown, "video_id", 10.0).select("l.video_id", "l.seq", "r.shot")


@query("join3_lookup", f"WITH {VIDEOS_SQL} SELECT f.frame_no, round(f.t_s / v.duration, 6) AS share FROM frames f JOIN videos v USING (video_id) WHERE v.duration > 0")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = schemas.frames(spark, sf_dir).join(schemas.videos(spark, sf_dir), "video_id").where("duration > 0")
    return joined.select("frame_no", F.round(F.col("t_s") / F.col("duration"), 6).alias("share"))


@query("itv1_own_clip", f"WITH {FRAMES_SQL} SELECT frame_no, c AS clip_no FROM frames, range(20) r(c) WHERE NOT (c * 10 <= (frame_no % 200) AND (frame_no % 200) <= c * 10 + 10)")
def itv_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    from temporis.operators.retrieval import excluding_own

    rows = schemas.frames(spark, sf_dir).select("frame_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("clip_no"))
    return excluding_own(rows, F.col("frame_no") % 200)


@query("itv2_widen_point", f"WITH {FRAMES_SQL} SELECT frame_no, round(t_s - 1, 6) AS start_s, round(t_s + 1, 6) AS end_s FROM frames")
def itv_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = interval.widen_point(F.col("t_s"))
    return schemas.frames(spark, sf_dir).select("frame_no", F.round(w["start_s"], 6).alias("start_s"), F.round(w["end_s"], 6).alias("end_s"))


@query("itv3_widen_short", f"WITH {_ASK} SELECT ask, round(wb, 6) AS start_s, round(we, 6) AS end_s FROM wide")
def itv_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = interval.widen_short(F.col("b"), F.col("e"))
    return _asks(spark, sf_dir).select("ask", F.round(w["start_s"], 6).alias("start_s"), F.round(w["end_s"], 6).alias("end_s"))


@query("itv4_clip_interval", f"WITH {_CLIPS} SELECT video_id, clip_no, clip_no * 10.0::DOUBLE AS start_s, clip_no * 10.0::DOUBLE + 10 AS end_s FROM clips")
def itv_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = interval.of_clip(F.col("clip_no"))
    return _clips(spark, sf_dir).select("video_id", "clip_no", own["start_s"].alias("start_s"), own["end_s"].alias("end_s"))


@query("itv5_clamp", f"WITH {FRAMES_SQL}, c AS (SELECT frame_no, greatest(0, least(t_s - 700, 800)) AS b, greatest(0, least(t_s - 650, 800)) AS e FROM frames) SELECT frame_no, round(CASE WHEN e <= b THEN e - 1 ELSE b END, 6) AS start_s, round(e, 6) AS end_s FROM c")
def itv_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = interval.clamp(F.col("t_s") - 700, F.col("t_s") - 650, F.lit(800.0))
    return schemas.frames(spark, sf_dir).select("frame_no", F.round(c["start_s"], 6).alias("start_s"), F.round(c["end_s"], 6).alias("end_s"))


@query("set3_last_text_wins", f"WITH {SUBTITLES_SQL}, r AS (SELECT video_id, floor(start_s / 40) AS a, seq, text FROM subtitles) SELECT video_id, a AS start_s, min(seq) AS seq, max_by(text, seq) AS text FROM r GROUP BY 1, 2")
def set_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schemas.subtitles(spark, sf_dir).withColumn("start_s", F.floor(F.col("start_s") / 40).cast("double")).withColumn("end_s", F.col("start_s") + 40)
    return validity.last_text_wins(rows).select("video_id", "start_s", "seq", "text")


@query("src6_flat_subtitles", f"WITH {SUBTITLES_SQL} SELECT video_id, string_agg(CAST(floor(start_s) AS BIGINT) || '-' || CAST(floor(end_s) AS BIGINT) || ':' || text, ' ' ORDER BY seq) || ' ' AS subtitles FROM subtitles GROUP BY 1")
def src_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subs.flat(schemas.subtitles(spark, sf_dir))


_SRT = SUBTITLES_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1 AS k FROM subtitles)"""


def _srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT text written from the stand-in subtitles, some of it in font tags."""
    rows = schemas.subtitles(spark, sf_dir)
    code = lambda s: F.concat(timecode.clock(s, ":"), F.lit(","), F.lpad((F.floor(s * 1000) % 1000).cast("string"), 3, "0"))
    said = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('<font color="white" size=".72c">'), F.col("text"), F.lit("</font>"))).otherwise(F.col("text"))
    block = F.concat(F.col("seq").cast("string"), F.lit("\n"), code(F.col("start_s")), F.lit(" --> "), code(F.col("end_s")), F.lit("\n"), said)
    ordered = F.array_sort(F.collect_list(F.struct("seq", block.alias("block"))))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("content"))


@query("src3_srt_parse", f"WITH {_SRT} SELECT video_id, CAST(k AS INTEGER) AS seq, round(floor(start_s * 1000) / 1000, 3) AS start_s, round(floor(end_s * 1000) / 1000, 3) AS end_s, text, 'ok' AS status FROM n")
def src_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = subs.parse_srt(_srt_files(spark, sf_dir))
    return done.withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


@query("src4_json_parse", f"WITH {SUBTITLES_SQL} SELECT video_id, count(*) AS n, CAST(sum(floor(start_s)) AS DOUBLE) AS total FROM subtitles GROUP BY 1")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schemas.subtitles(spark, sf_dir)
    code = lambda c: F.concat(timecode.clock(F.col(c), ":"), F.lit(",000"))
    files = rows.groupBy("video_id").agg(F.to_json(F.collect_list(F.struct(code("start_s").alias("start"), code("end_s").alias("end"), F.col("text").alias("line")))).alias("content"))
    return subs.parse_json(files).where("status = 'ok'").groupBy("video_id").agg(F.count("*").alias("n"), F.sum("start_s").alias("total"))


@query("src5_font_tag", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '!' ELSE lang END AS text FROM documents")
def src_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('x <font color="white" size=".72c">'), F.col("lang"), F.lit('!</font> <font color="white" size=".72c">no</font>'))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_font(tagged).alias("text"))


@query("win5_neighbours", f"WITH {_CLIPS}, l AS (SELECT video_id, max(clip_no) AS last_no FROM expected GROUP BY 1) SELECT DISTINCT c.video_id, CAST(c.clip_no + d AS INTEGER) AS clip_no FROM clips c JOIN l USING (video_id), range(-1, 2) r(d) WHERE c.clip_no + d BETWEEN 0 AND l.last_no")
def win_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _expected(spark, sf_dir).groupBy("video_id").agg(F.max("clip_no").alias("last_no"))
    return evaluate.neighbours(_clips(spark, sf_dir).join(last, "video_id"))


@query("win6_segments_merge", f"WITH {_CLIPS}, i AS (SELECT video_id, clip_no, clip_no - row_number() OVER (PARTITION BY video_id ORDER BY clip_no) AS g FROM clips), p AS (SELECT *, (row_number() OVER (PARTITION BY video_id, g ORDER BY clip_no) - 1) // 2 AS part FROM i) SELECT video_id, min(clip_no) AS first_no, max(clip_no) AS last_no FROM p GROUP BY video_id, g, part")
def win_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.merge_adjacent(_clips(spark, sf_dir))


@query("agg1_clip_counts", f"WITH {_CLIPS} SELECT video_id, CAST(count_if(is_valid) AS BIGINT) AS valid, CAST(count_if(NOT is_valid) AS BIGINT) AS invalid, max(clip_no) AS last_no FROM clips GROUP BY 1")
def agg_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).groupBy("video_id").agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.max("clip_no").alias("last_no"))


@query("srt1_frame_order", f"WITH {FRAMES_SQL} SELECT video_id, frame_no, CAST(row_number() OVER (PARTITION BY video_id ORDER BY t_s, frame_no) AS INTEGER) AS place FROM frames")
def srt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By time; of one time, by number."""
    rows = sample.placed(schemas.frames(spark, sf_dir), ["video_id"], ["t_s", "frame_no"], "place")
    return rows.select("video_id", "frame_no", (F.col("place") + 1).alias("place"))


@query("mth2_resize", "SELECT p_partkey, CASE WHEN h > w THEN CAST(floor(w * (748 / h::DOUBLE)) AS INTEGER) ELSE 748 END AS width, CASE WHEN h > w THEN 748 ELSE CAST(floor(h * (748 / w::DOUBLE)) AS INTEGER) END AS height FROM (SELECT p_partkey, p_size + 100 AS w, p_partkey % 97 + 90 AS h FROM part)")
def mth_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = numeric.resize(F.col("p_size") + 100, F.col("p_partkey") % 97 + 90)
    return table(spark, sf_dir, "part").select("p_partkey", r["width"].alias("width"), r["height"].alias("height"))


@query("mth3_linspace", "SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = 7 THEN n - 1 ELSE floor(i * ((n - 1) / 7.0::DOUBLE)) END AS INTEGER) AS place FROM (SELECT p_partkey, p_size + 8 AS n FROM part), range(8) r(i)")
def mth_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(numeric.linspace_indices(F.col("p_size") + 8, 8)).alias("i", "place"))


@query("src10_uniform_frames", f"WITH {FRAMES_SQL}, c AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) SELECT video_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = 7 THEN n - 1 ELSE floor(i * ((n - 1) / 7.0::DOUBLE)) END AS INTEGER) AS place FROM c, range(8) r(i)")
def src_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = schemas.frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    return n.select("video_id", F.posexplode(numeric.linspace_indices(F.col("n"), 8)).alias("i", "place"))


_SIGNAL = "sig AS (SELECT user_id, list(value ORDER BY event_id) AS v, avg(value) AS m FROM events GROUP BY 1)"


@query("mth4_audio", f"WITH {_SIGNAL}, c AS (SELECT user_id, unnest(v) - m AS x FROM sig) SELECT user_id, count(*) AS n, round(sum(x * x), 4) AS power FROM c GROUP BY 1")
def mth_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    signal = table(spark, sf_dir, "events").groupBy("user_id").agg(numeric.centred(ordered).alias("v"))
    return signal.select("user_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("power"))


@query("mth4_audio_standardise", f"WITH {_SIGNAL}, r AS (SELECT user_id, v, len(v) AS n FROM sig), p AS (SELECT user_id, v[CAST(i % n AS BIGINT) + 1] AS x FROM r, range(500) g(i)) SELECT user_id, round(sum((x - 0.5) / (0.5 * 2)), 4) AS total FROM p GROUP BY 1")
def mth_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    signal = table(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("v"))
    done = numeric.standardised(numeric.repeat_to(F.col("v"), 500), AUDIO_MEAN, AUDIO_STD)
    return signal.select("user_id", F.round(F.aggregate(done, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("mth5_depth", "SELECT user_id, round(sum(least(greatest(value * 900 / 1000, 0.01), 10.0) / 10.0), 5) AS total FROM events GROUP BY 1")
def mth_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] * 900).alias("v"))
    return values.select("user_id", F.round(F.aggregate(numeric.depth(F.col("v")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("str3_paths", "SELECT doc_id, 'data/subtitles/' || source || '.part' || doc_id || '.srt' AS subtitle, source AS first_stem, source || '.part' || doc_id AS last_stem FROM documents")
def str_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("data/videos/"), F.col("source"), F.lit(".part"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    return table(spark, sf_dir, "documents").select("doc_id", timecode.subtitle_path(path).alias("subtitle"), timecode.stem(path).alias("first_stem"), timecode.stem(path, False).alias("last_stem"))


@query("str1_timecode", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 * 3600 + event_id % 60 * 60 + event_id % 59 + event_id % 1000 / 1000.0::DOUBLE END AS seconds FROM events")
def str_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    code = F.when(e % 11 == 0, F.lit("00:0x:10,1")).otherwise(F.format_string("%02d:%02d:%02d,%d", e % 5, e % 60, e % 59, e % 1000))
    return table(spark, sf_dir, "events").select("event_id", timecode.parse_timecode(code).alias("seconds"))


@query("str12_base64", "SELECT page_id, 'data:image/jpeg;base64,' || to_base64(encode(url)) AS data_url FROM pages")
def str_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.data_url(F.col("url").cast("binary")).alias("data_url"))

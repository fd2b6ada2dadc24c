"""The engine's front door: the reference's entry points as methods that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.operators import interval, retrieval, sample, segment, toolcall
from temporis.sources.files import Settings


class Engine:
    """Clips, subtitles and vectors of many videos; each call takes all queries at once."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings.load(spark)

    def clips(self, videos: DataFrame, clamp: bool = True) -> DataFrame:
        return segment.clip_grid(videos, self.settings.clip_duration, clamp)

    def informative_clips(self, queries: DataFrame, vectors: DataFrame, **mode) -> DataFrame:
        """queries (query_id, video_id, query) -> the clips of the query's video, best first."""
        return retrieval.search(queries, vectors, "query_id", "clip_no", ["video_id"], True, **mode)

    def informative_clips_with_video(self, queries: DataFrame, vectors: DataFrame, **mode) -> DataFrame:
        """As informative_clips, by the sum of a video's and a text's unit vectors (video_query, text_query)."""
        return retrieval.search_fused(queries, vectors, "query_id", "clip_no", ["video_id"], **mode)

    def informative_subtitles(self, queries: DataFrame, vectors: DataFrame, top_k: int = 1) -> DataFrame:
        """Raw inner products: subtitle vectors come normalised from their encoder."""
        return retrieval.search(queries, vectors, "query_id", "seq", ["video_id"], False, top_k=top_k)

    def calls(self, turns: DataFrame, compat: str = "literal") -> DataFrame:
        return toolcall.parse(turns, compat, self.settings.subtitle_k)

    def reader_plan(self, calls: DataFrame, frames: DataFrame, compat: str = "fixed") -> DataFrame:
        """conv_id, turn, call_no, video_id, question, frames, points: the times of the frames that each video_reader call gets, and the times that were
        asked for."""
        reads = calls.where("tool = 'video_reader'")
        spans = toolcall.ranges(reads).withColumn("points", sample.interval_points(F.col("begin_s"), F.col("end_s"), self.settings.clip_fps))
        from temporis.functions.text import clip_numbers

        listed = reads.where(~F.contains("body", F.lit(":"))).withColumn("n", F.explode(clip_numbers(F.col("body"))))
        listed = listed.withColumn("points", sample.clip_points(F.col("n"), self.settings.clip_duration, self.settings.clip_fps))
        keys = ["conv_id", "turn", "call_no", "video_id", "question"]
        points = spans.select(*keys, F.explode("points").alias("t")).unionByName(listed.select(*keys, F.explode("points").alias("t")))
        return self._frames_at(points, frames, keys, compat)

    def browser_plan(self, calls: DataFrame, videos: DataFrame, frames: DataFrame, compat: str = "fixed") -> DataFrame:
        """conv_id, turn, video_id, question, frames, points: as reader_plan, of the whole video, for each video_browser call.

        The frames are those of [0, duration], found once for each video that is asked about: for each frame the run of points that it is nearest to, so
        the work grows with frames, not with the points of long videos.
        """
        asked, kept = calls.where("tool = 'video_browser'"), self.settings
        whole = videos.join(asked.select("video_id").distinct(), "video_id", "left_semi")
        span = interval.widen_short(F.lit(0.0), F.col("duration"))
        grids = whole.select("video_id", span["start_s"].alias("start_s"), F.floor((span["end_s"] - span["start_s"]) * kept.clip_fps).cast("int").alias("n"))
        runs = sample.grid_runs(grids, frames, kept.clip_fps).where("nearest.is_valid")
        seen = sample.thinned_runs(runs, kept.clip_fps, "video_id", "stride" if compat == "literal" else "uniform", kept.max_frames, kept.min_frames)
        seen = seen.select("video_id", F.transform("frames", lambda x: x["t_s"]).alias("frames"), F.transform("frames", lambda x: x["t"]).alias("points"))
        return asked.select("conv_id", "turn", "video_id", "question").join(seen, "video_id")

    def _frames_at(self, points: DataFrame, frames: DataFrame, keys: list[str], compat: str) -> DataFrame:
        """keys, frames, points: the times of the readable frames nearest to the points (t), and those points, thinned and filled up. A time of a video
        that several calls ask for is looked up once."""
        found = sample.readable_frames(points.select("video_id", "t").distinct(), frames).select("video_id", "t", F.col("nearest.t_s").alias("t_s"))
        near = points.join(found, ["video_id", "t"]).select(*keys, "t", "t_s")
        kept = sample.thinned(near, keys, ["t", "t_s"], "stride" if compat == "literal" else "uniform", self.settings.max_frames, self.settings.min_frames)
        return kept.select(*keys, F.transform("frames", lambda x: x["t_s"]).alias("frames"), F.transform("frames", lambda x: x["t"]).alias("points"))

    def segment_hits(self, calls: DataFrame, vectors: DataFrame, encoded: DataFrame) -> DataFrame:
        """conv_id, turn, call_no, sub_no, sub_query, clip_no, score, rank of each textual retriever call's sub-queries: the topk clips of the call's
        video each. encoded: sub_query -> query, the vectors that an encoder gives for them."""
        return self._sub_hits(calls, "video_segment_retriever_textual_query", vectors, encoded, "clip_no", True)

    def subtitle_hits(self, calls: DataFrame, subtitles: DataFrame, vectors: DataFrame, encoded: DataFrame) -> DataFrame:
        """conv_id, turn, call_no, body, seq, start_s, end_s, text of each subtitle_retriever call: the topk subtitles of each sub-query, of those that
        start at the same time the first."""
        hits = self._sub_hits(calls, "subtitle_retriever", vectors, encoded, "seq", False)
        timed = hits.join(subtitles, ["video_id", "seq"])
        return retrieval.merge_sub_queries(timed, ["conv_id", "turn", "call_no"])

    def _sub_hits(self, calls: DataFrame, tool: str, vectors: DataFrame, encoded: DataFrame, item: str, normalised: bool) -> DataFrame:
        keys = ["conv_id", "turn", "call_no", "sub_no"]
        subs = toolcall.sub_calls(calls.where(F.col("tool") == tool)).where("topk > 0").join(encoded, "sub_query")
        queries = subs.select(F.concat_ws(":", *keys).alias("query_id"), *keys, "body", "sub_query", "topk", "video_id", "query")
        most = queries.agg(F.max("topk")).first()[0] or 1
        hits = retrieval.search_blocks(queries, vectors, most, item=item, on=["video_id"], normalised=normalised)
        return hits.join(queries.drop("query", "video_id"), "query_id").where("rank <= topk").drop("query_id", "topk")

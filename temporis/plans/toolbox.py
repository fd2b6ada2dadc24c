"""The tool executor: all six tools, for all live conversations of a round, as one plan.

Calls are parsed once; each tool that a round asks for is a plan over all calls of its kind (frames by nearest-in-time joins, hits by block search within
the call's video, subtitles by interval join), and the results, keyed by (conv_id, turn, priority, call_no, sub_no), are put together in the order
in which tools run. A Toolbox is the `tools` of agent.run_rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temporis.functions import timecode
from temporis.operators import agent, calls, interval, retrieval, toolcall
from temporis.plans.engine import Engine

#: What a vision model is asked, before and after a call's question, for clips and for whole videos.
WATCH = "Please watch the given video and answer the following question: "
DESCRIBE = "Output the detailed video description and the answer in this format: The {}description of the video is:YOUR_DESCRIPTION\nThe answer is:YOUR_ANSWER. If the question includes options, you may select one or multiple correct choices or none."
KEYS = ["conv_id", "turn", "priority", "call_no"]
RESULT = [*KEYS, "sub_no", "tool", "result"]


class Toolbox:
    """Tables of the videos, and the model plug-ins, that tools work with.

    subjects: conv_id, video_id, question (what an image query's text is), and, where there, offset_s, the time in the video's subtitles at which it
    starts. videos: video_id, duration. frames: video_id, t_s, frame_no, is_valid. clips: video_id, clip_no, embedding. subtitles: video_id,
    seq, start_s, end_s, text. subtitle_vectors: video_id, seq, embedding. encode: a table of texts (column text) -> text, query.
    moments: (video_id, t) -> video_id, t, video_query, the vector of what is seen about that time. vision: a plug-in that is
    given a message's parts, a list of (type, value). save writes a table and reads it back, drop deletes one.
    """

    def __init__(
        self, engine: Engine, subjects: DataFrame, videos: DataFrame, frames: DataFrame, clips: DataFrame, subtitles: DataFrame, subtitle_vectors: DataFrame,
        encode: Callable[[DataFrame], DataFrame], moments: Callable[[DataFrame], DataFrame], vision: calls.Model, save: Callable[[DataFrame, str], DataFrame], drop: Callable[..., None] = lambda *_: None, compat: str = "fixed", topk: str = "literal", **limits,
    ) -> None:
        self.engine, self.videos, self.frames, self.clips = engine, videos, frames, clips
        subjects = subjects if "offset_s" in subjects.columns else subjects.withColumn("offset_s", F.lit(0.0))
        self.subjects = subjects.select("conv_id", "video_id", F.col("question").alias("about"), F.coalesce("offset_s", F.lit(0.0)).alias("offset_s"))
        self.subtitles, self.subtitle_vectors = subtitles, subtitle_vectors
        self.encode, self.moments, self.vision, self.save, self.drop = encode, moments, vision, save, drop
        self.compat, self.topk, self.limits, self._known = compat, topk, limits, None

    def __call__(self, turns: DataFrame) -> DataFrame:
        """turns (conv_id, turn, text) -> conv_id, turn, tool_result, tools, of the turns whose calls gave results."""
        return toolcall.results(self.run(turns))

    def run(self, turns: DataFrame) -> DataFrame:
        """conv_id, turn, priority, call_no, sub_no, tool, result of all calls. Calls that can't be read (no such clip, no number) have none."""
        before, known = self._known, self.save(self.engine.calls(turns, self.topk).join(self.subjects, "conv_id"), "toolbox-calls")
        self.drop(before)  # the calls of the round before: its results are in the log
        self._known = known
        asked = {r["tool"] for r in known.select("tool").distinct().collect()}  # six names at most
        plans = {
            self.read: {"video_reader", "video_browser"}, self.search_clips: {"video_segment_retriever_textual_query"}, self.search_by_image: {"video_segment_retriever_image_query"},
            self.search_subtitles: {"subtitle_retriever"}, self.extract_subtitles: {"subtitle_extractor"},
        }
        parts = [plan(known).select(*RESULT) for plan, tools in plans.items() if tools & asked]
        none = known.limit(0).select(*KEYS, F.lit(0).alias("sub_no"), "tool", F.lit("").alias("result"))
        return reduce(DataFrame.unionByName, parts) if parts else none

    def read(self, known: DataFrame) -> DataFrame:
        """video_reader and video_browser: frames, asked about in one step over all calls of both."""
        same = ["conv_id", "turn", "call_no", "video_id", "question"]
        reader = self.engine.reader_plan(known, self.frames, self.compat).select(*same, "frames", "points", F.lit(0).alias("priority"))
        browser = self.engine.browser_plan(known, self.videos, self.frames, self.compat).select("*", F.lit(0).alias("call_no"), F.lit(1).alias("priority")).select(*reader.columns)
        plan = reader.unionByName(browser)
        kind = F.when(F.col("priority") == 1, F.lit(DESCRIBE.format("detailed "))).otherwise(F.lit(DESCRIBE.format("")))
        names = F.transform("frames", lambda t: F.concat(F.col("video_id").cast("string"), F.lit("/"), timecode.frame_name(t)))
        content = agent.frame_content(names, F.col("points"), F.concat(F.lit(WATCH), F.col("question"), kind))
        said = calls.ask(plan.select(*KEYS, content.alias("content")), self.vision, "content", **({"tries": 5} | self.limits))
        told = known.select(*KEYS, "tool", F.when(F.col("priority") == 1, F.col("question")).otherwise(F.col("body")).alias("asked")).join(said, KEYS)
        return told.select(*KEYS, F.lit(0).alias("sub_no"), "tool", toolcall.result_text(F.col("tool"), F.col("asked"), F.coalesce("text", F.lit("None"))).alias("result"))

    def _subs(self, known: DataFrame, tool: str) -> DataFrame:
        return toolcall.sub_calls(known.where(F.col("tool") == tool))

    def _found(self, subs: DataFrame, hits: DataFrame, item: str) -> DataFrame:
        """The lists of items that each sub-query is told, best first; an empty one where nothing is found."""
        ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("x"))))
        lists = hits.groupBy(*KEYS, "sub_no").agg(F.transform(ordered, lambda x: x["x"]).alias("found"))
        both = subs.join(lists, [*KEYS, "sub_no"], "left")
        return both.select(*KEYS, "sub_no", "tool", toolcall.result_text(F.col("tool"), F.col("sub_query"), toolcall.listed(F.col("found"))).alias("result"))

    def _encoded(self, texts: DataFrame, column: str) -> DataFrame:
        """texts with query, the vector of a column's text; those without one go."""
        vectors = self.encode(texts.select(F.col(column).alias("text")).where("text is not null").distinct())
        return texts.join(vectors.select(F.col("text").alias(column), "query"), column)

    def _hits(self, queries: DataFrame, items: DataFrame, item: str, normalised: bool = True, digits: int | None = None) -> DataFrame:
        """KEYS, sub_no, item, rank: of each query (query, most) the most best items of its video. Calls that ask a video by the same vector are one
        search, so the work grows with what is asked, not with how often."""
        vector_text = F.array_join(F.transform("query", lambda x: x.cast("double").cast("string")), ",", "null")
        queries = queries.where("most > 0").withColumn("query_id", F.concat_ws(":", "video_id", F.sha2(vector_text, 256)))
        most = queries.agg(F.max("most")).first()[0]
        if most is None:  # nobody asks
            return queries.drop("query").withColumns({item: F.lit(None).cast(dict(items.dtypes)[item]), "rank": F.lit(0)}).limit(0)
        asked = queries.select("query_id", "video_id", "query").dropDuplicates(["query_id"])
        found = retrieval.search_blocks(asked, items, most, item=item, on=["video_id"], normalised=normalised, digits=digits)
        return found.drop("video_id").join(queries.drop("query"), "query_id").where("rank <= most")

    def search_clips(self, known: DataFrame) -> DataFrame:
        subs = self._subs(known, "video_segment_retriever_textual_query")
        return self._found(subs, self._hits(self._encoded(subs, "sub_query").withColumn("most", F.col("topk")), self.clips, "clip_no"), "clip_no")

    def search_by_image(self, known: DataFrame) -> DataFrame:
        """By what is seen at a time and by the conversation's question, one clip more than asked for, then without the clips of that time."""
        subs = self._subs(known, "video_segment_retriever_image_query").withColumn("t", F.trim("sub_query").try_cast("double")).where("t is not null")
        seen = self.moments(subs.select("video_id", "t").distinct())
        both = self._encoded(subs, "about").withColumnRenamed("query", "text_query").join(seen, ["video_id", "t"])
        queries = retrieval.fused(both.withColumn("most", F.col("topk") + 1))
        unit = self.clips.withColumn("embedding", retrieval.vector.normalise(F.col("embedding")))
        hits = self._hits(queries, unit, "clip_no", normalised=False, digits=9)
        return self._found(subs, retrieval.excluding_own(hits, F.col("t"), self.engine.settings.clip_duration), "clip_no")

    def _shown(self, rows: DataFrame, text: str, order: list[str], whole: bool, by: list[str]) -> DataFrame:
        """shown: the subtitles of each call, as the model is told of them."""
        time = lambda c: (F.col(c).cast("long") if whole else F.col(c).cast("double")).cast("string")
        said = F.concat(F.lit("{'begin_timestamp': "), time("start_s"), F.lit(", 'end_timestamp': "), time("end_s"), F.lit(f", '{text}': "), toolcall.quoted(F.col("text")), F.lit("}"))
        ordered = F.array_sort(F.collect_list(F.struct(*order, said.alias("x"))))
        return rows.groupBy(*by).agg(F.transform(ordered, lambda x: x["x"]).alias("shown"))

    def search_subtitles(self, known: DataFrame) -> DataFrame:
        """By call: what its sub-queries find, subtitles that start together once, in order of time, less the video's own start."""
        of_tool = known.where("tool = 'subtitle_retriever'")
        subs = self._encoded(self._subs(known, "subtitle_retriever").withColumn("most", F.col("topk")), "sub_query")
        hits = self._hits(subs, self.subtitle_vectors, "seq", normalised=False).select(*KEYS, "sub_no", "rank", "video_id", "seq", "offset_s")
        first = retrieval.merge_sub_queries(hits.join(self.subtitles, ["video_id", "seq"]), KEYS)
        moved = first.withColumns({c: F.col(c) - F.col("offset_s") for c in ("start_s", "end_s")})
        both = of_tool.join(self._shown(moved, "text", ["start_s", "sub_no", "rank"], False, KEYS), KEYS, "left")
        return both.select(*KEYS, F.lit(0).alias("sub_no"), "tool", toolcall.result_text(F.col("tool"), F.col("body"), toolcall.listed(F.col("shown"))).alias("result"))

    def extract_subtitles(self, known: DataFrame) -> DataFrame:
        """By range of a call: the subtitles that start in it, by a join on cells of time; a range of a video that several calls ask for is read once."""
        subs = self._subs(known, "subtitle_extractor")
        ends = F.split("sub_query", ":")
        number = lambda k: F.trim(F.get(ends, F.lit(k))).try_cast("double")
        asked = subs.withColumn("start_s", number(0) + F.col("offset_s")).withColumn("end_s", number(1) + F.col("offset_s")).where("start_s is not null and end_s is not null")
        points = self.subtitles.select("video_id", "start_s", F.col("start_s").alias("end_s"), F.struct("seq", "start_s", "end_s", "text").alias("s"))
        spans = ["video_id", "begin_s", "until_s"]
        asked = asked.withColumns({"begin_s": F.col("start_s"), "until_s": F.col("end_s")})
        pairs = interval.overlap_join(asked.select(*spans, "start_s", "end_s").distinct(), points, "video_id", self.engine.settings.clip_duration)
        found = pairs.select(*(F.col(f"l.{c}").alias(c) for c in spans), "r.s.*")
        both = asked.drop("start_s", "end_s").join(self._shown(found, "subtitle", ["start_s", "seq"], True, spans), spans, "left")
        return both.select(*KEYS, "sub_no", "tool", toolcall.result_text(F.col("tool"), F.col("sub_query"), toolcall.listed(F.col("shown"))).alias("result"))

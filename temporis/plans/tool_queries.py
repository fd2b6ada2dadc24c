"""Tool-call, conversation, evaluation and result queries.

The driver's conversations hold no markup, so calls are written into them the same way here and in SQL: an assistant turn asks
tools by its turn and conversation number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temporis import schemas
from temporis.functions import text as T
from temporis.operators import agent, evaluate, toolcall, validity
from temporis.registry import query
from temporis.session import table
from temporis.sources.files import Settings

_RETRIEVE, _SUBS, _IMAGE = "video_segment_retriever_textual_query", "subtitle_retriever", "video_segment_retriever_image_query"

_TURNS = f"""turns AS (
  SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN text
    WHEN (conv_id + turn) % 4 = 0 THEN '<thinking>' || text || '</thinking><{_SUBS}>a' || turn || ';b</{_SUBS}><topk>' || (turn + 3) || '</topk>'
    WHEN (conv_id + turn) % 4 = 1 THEN '<thinking>t</thinking><{_SUBS}>a</{_SUBS}><topk>30</topk><{_RETRIEVE}>c;d;e</{_RETRIEVE}><topk>' || CASE WHEN conv_id % 2 = 0 THEN '7' ELSE 'x' END || '</topk>'
    WHEN (conv_id + turn) % 4 = 2 THEN '<video_reader>' || turn || '; 2;3</video_reader><video_reader_question>q' || conv_id || '</video_reader_question><subtitle_extractor>0:60;90:120</subtitle_extractor>'
    WHEN conv_id % 3 = 0 THEN '<answer>option (' || chr(CAST(65 + conv_id % 5 AS INTEGER)) || ')</answer>'
    ELSE text END AS text FROM conversations
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    c, t, x = F.col("conv_id"), F.col("turn"), F.col("text")
    kind = (c + t) % 4
    lit = F.lit
    said = (
        F.when(F.col("role") != "assistant", x)
        .when(kind == 0, F.concat(lit("<thinking>"), x, lit(f"</thinking><{_SUBS}>a"), t.cast("string"), lit(f";b</{_SUBS}><topk>"), (t + 3).cast("string"), lit("</topk>")))
        .when(
            kind == 1,
            F.concat(lit(f"<thinking>t</thinking><{_SUBS}>a</{_SUBS}><topk>30</topk><{_RETRIEVE}>c;d;e</{_RETRIEVE}><topk>"), F.when(c % 2 == 0, "7").otherwise("x"), lit("</topk>")),
        )
        .when(
            kind == 2,
            F.concat(
                lit("<video_reader>"), t.cast("string"), lit("; 2;3</video_reader><video_reader_question>q"), c.cast("string"),
                lit("</video_reader_question><subtitle_extractor>0:60;90:120</subtitle_extractor>"),
            ),
        )
        .when(c % 3 == 0, F.concat(lit("<answer>option ("), F.char(65 + c % 5), lit(")</answer>")))
        .otherwise(x)
    )
    return rows.select("conv_id", "turn", "role", said.alias("text"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'assistant'")


_PARSED = (
    _TURNS
    + f""", clean AS (
  SELECT conv_id, turn, CASE WHEN contains(text, '</thinking>') THEN split_part(text, '</thinking>', 2) ELSE text END AS s FROM turns WHERE role = 'assistant'
), k AS (SELECT *, regexp_extract_all(s, '(?s)<topk>(.*?)</topk>', 1) AS ks FROM clean),
reader AS (SELECT conv_id, turn, 0 AS priority, 'video_reader' AS tool, unnest(regexp_extract_all(s, '<video_reader>([^<]+)</video_reader>', 1)) AS body, unnest(range(len(regexp_extract_all(s, '<video_reader>([^<]+)</video_reader>', 1)))) AS call_no, unnest(regexp_extract_all(s, '<video_reader_question>([^<]+)</video_reader_question>', 1)) AS question, NULL AS topk FROM k),
seg AS (SELECT conv_id, turn, 2 AS priority, '{_RETRIEVE}' AS tool, unnest(regexp_extract_all(s, '(?s)<{_RETRIEVE}>(.*?)</{_RETRIEVE}>', 1)) AS body, unnest(range(len(regexp_extract_all(s, '(?s)<{_RETRIEVE}>(.*?)</{_RETRIEVE}>', 1)))) AS call_no, NULL AS question, ks FROM k),
sub AS (SELECT conv_id, turn, 4 AS priority, '{_SUBS}' AS tool, unnest(regexp_extract_all(s, '(?s)<{_SUBS}>(.*?)</{_SUBS}>', 1)) AS body, unnest(range(len(regexp_extract_all(s, '(?s)<{_SUBS}>(.*?)</{_SUBS}>', 1)))) AS call_no, NULL AS question, ks FROM k),
ext AS (SELECT conv_id, turn, 5 AS priority, 'subtitle_extractor' AS tool, unnest(regexp_extract_all(s, '(?s)<subtitle_extractor>(.*?)</subtitle_extractor>', 1)) AS body, unnest(range(len(regexp_extract_all(s, '(?s)<subtitle_extractor>(.*?)</subtitle_extractor>', 1)))) AS call_no, NULL AS question, NULL AS topk FROM k),
calls AS (
  SELECT conv_id, turn, priority, call_no, tool, body, question, CAST(topk AS INTEGER) AS topk FROM reader
  UNION ALL SELECT conv_id, turn, priority, call_no, tool, body, question, coalesce(try_cast(trim(ks[call_no + 1]) AS INTEGER), 5) FROM seg
  UNION ALL SELECT conv_id, turn, priority, call_no, tool, body, question, coalesce(try_cast(trim(ks[call_no + 1]) AS INTEGER), 15) FROM sub
  UNION ALL SELECT conv_id, turn, priority, call_no, tool, body, question, CAST(topk AS INTEGER) FROM ext
)"""
)


@query("tool8_calls", f"WITH {_PARSED} SELECT conv_id, turn, priority, CAST(call_no AS INTEGER) AS call_no, tool, body, question, topk FROM calls")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcall.parse(_spoken(spark, sf_dir))


@query(
    "tool7_topk_scoped",
    f"WITH {_PARSED} SELECT conv_id, turn, tool, CASE WHEN tool = '{_RETRIEVE}' THEN CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 5 END WHEN body = 'a' THEN 30 ELSE CAST(turn + 3 AS INTEGER) END AS topk FROM calls WHERE tool IN ('{_RETRIEVE}', '{_SUBS}')",
)
def tool_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = toolcall.parse(_spoken(spark, sf_dir), "scoped")
    return calls.where(F.col("tool").isin(_RETRIEVE, _SUBS)).select("conv_id", "turn", "tool", "topk")


@query("tool3_sub_queries", f"WITH {_PARSED} SELECT conv_id, turn, CAST(call_no AS INTEGER) AS call_no, CAST(i AS INTEGER) AS sub_no, string_split(body, ';')[CAST(i AS BIGINT) + 1] AS sub_query, topk FROM calls, range(3) r(i) WHERE tool = '{_RETRIEVE}' AND i < len(string_split(body, ';'))")
def tool_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = toolcall.parse(_spoken(spark, sf_dir)).where(F.col("tool") == _RETRIEVE)
    return toolcall.sub_calls(calls).select("conv_id", "turn", "call_no", "sub_no", "sub_query", "topk")


@query("tool1_reader_clips", f"WITH {_PARSED} SELECT conv_id, turn, question, CASE WHEN turn <= 3 THEN CAST(turn AS VARCHAR) || ',3' ELSE '3,' || turn END AS clips FROM calls WHERE tool = 'video_reader'")
def tool_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = toolcall.parse(_spoken(spark, sf_dir)).where("tool = 'video_reader'")
    return calls.select("conv_id", "turn", "question", F.array_join(T.clip_numbers(F.col("body")).cast("array<string>"), ",").alias("clips"))


#: Frames that calls get: of the readable frames nearest to the points, 32 at even distances where there are more, repeated up to 10 where there are fewer.
_KEPT = "CASE WHEN m > 32 THEN 32 WHEN m < 10 THEN 10 ELSE m END"
_THIN = f"round(list_sum(list_transform(range(CAST({_KEPT} AS BIGINT)), lambda p: l[CAST(CASE WHEN m > 32 THEN floor(p * (m / 32.0::DOUBLE)) WHEN m < 10 THEN floor(p * (m / 10.0::DOUBLE)) ELSE p END AS BIGINT) + 1])), 4)"


@query(
    "tool1_reader_frames",
    f"""WITH {schemas.FRAMES_SQL}, {_PARSED},
  c AS (SELECT conv_id, turn, call_no, question, k, CASE k WHEN 0 THEN turn ELSE 3 END AS clip FROM calls, range(2) r(k) WHERE tool = 'video_reader'),
  p AS (SELECT *, clip * 10.0::DOUBLE + i * 0.5 AS t FROM c, range(20) r(i)),
  j AS (SELECT p.*, f.t_s, f.is_valid, row_number() OVER (PARTITION BY p.conv_id, p.turn, p.call_no, p.k, p.i ORDER BY abs(f.t_s - p.t), f.t_s, f.frame_no) AS n FROM p JOIN frames f ON f.video_id = p.conv_id),
  v AS (SELECT conv_id, turn, question, list(t_s ORDER BY t, t_s) AS l, count(*) AS m FROM j WHERE n = 1 AND is_valid GROUP BY conv_id, turn, call_no, question)
SELECT conv_id, turn, question, CAST({_KEPT} AS INTEGER) AS n_frames, {_THIN} AS seconds FROM v""",
)
def tool_reader_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's frames: calls to clips, points, nearest readable frames, thinned and filled up. A conversation is about the video of its number."""
    from temporis.plans.engine import Engine

    calls = toolcall.parse(_spoken(spark, sf_dir)).withColumn("video_id", F.col("conv_id"))
    plan = Engine(spark, Settings()).reader_plan(calls, schemas.frames(spark, sf_dir).select("video_id", "t_s", "frame_no", "is_valid"))
    return plan.select("conv_id", "turn", "question", F.size("frames").alias("n_frames"), _total("frames"))


def _total(times: str):
    return F.round(F.aggregate(times, F.lit(0.0), lambda s, t: s + t), 4).alias("seconds")


def _browser_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = F.concat(F.lit("<thinking>x</thinking><video_browser_question>what happens in "), F.col("conv_id").cast("string"), F.lit("?</video_browser_question><video_browser_question>no</video_browser_question>"))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ask.alias("text"))
    return toolcall.parse(rows).where("tool = 'video_browser'")


@query("tool2_browser", "SELECT conv_id, turn, 'The tool result of <video_browser_question>what happens in ' || conv_id || '?</video_browser_question> is:' || chr(10) || ' seen' || chr(10) AS told FROM conversations WHERE role = 'user'")
def tool_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _browser_calls(spark, sf_dir)
    return calls.select("conv_id", "turn", toolcall.result_text(F.col("tool"), F.col("question"), F.lit("seen")).alias("told"))


@query(
    "tool2_browser_frames",
    f"""WITH {schemas.VIDEOS_SQL}, a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'),
  w AS (SELECT video_id, CASE WHEN duration < 1 THEN duration + 0.5 ELSE duration END AS until FROM videos WHERE video_id IN (SELECT conv_id FROM a)),
  p AS (SELECT video_id, i, i * 0.5::DOUBLE AS t FROM (SELECT video_id, unnest(range(CAST(floor(until * 2) AS BIGINT))) AS i FROM w)),
  j AS (SELECT p.*, f.t_s, f.is_valid, row_number() OVER (PARTITION BY p.video_id, p.i ORDER BY abs(f.t_s - p.t), f.t_s, f.frame_no) AS n FROM p JOIN frames f USING (video_id)),
  v AS (SELECT video_id, list(t_s ORDER BY t, t_s) AS l, count(*) AS m FROM j WHERE n = 1 AND is_valid GROUP BY video_id)
SELECT c.conv_id, c.turn, CAST({_KEPT} AS INTEGER) AS n_frames, {_THIN} AS seconds FROM v JOIN conversations c ON c.conv_id = v.video_id AND c.role = 'user'""",
)
def tool_browser_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The browser's frames: the whole video, sampled and thinned."""
    from temporis.plans.engine import Engine

    calls = _browser_calls(spark, sf_dir).withColumn("video_id", F.col("conv_id"))
    plan = Engine(spark, Settings()).browser_plan(calls, schemas.videos(spark, sf_dir), schemas.frames(spark, sf_dir).select("video_id", "t_s", "frame_no", "is_valid"))
    return plan.select("conv_id", "turn", F.size("frames").alias("n_frames"), _total("frames"))


#: Stand-ins for encoders: a sub-query's vector is the row numbered by its first character's code and its length; a conversation's video is its number's last digit.
_CODE = "ascii(sub_query) + length(sub_query)"
_SUB_SQL = f"subs AS (SELECT *, unnest(string_split(body, ';')) AS sub_query, unnest(range(len(string_split(body, ';')))) AS sub_no FROM calls)"


def _encoded(spark: SparkSession, sf_dir: str, calls: DataFrame) -> DataFrame:
    subs = toolcall.sub_calls(calls).select("sub_query").distinct().withColumn("vec_id", (F.ascii("sub_query") + F.length("sub_query")).cast("long"))
    return subs.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query")), "vec_id").select("sub_query", "query")


def _scoped_calls(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    return toolcall.parse(_spoken(spark, sf_dir)).where(F.col("tool") == tool).withColumn("video_id", (F.col("conv_id") % 10).cast("int"))


@query(
    "tool3_segment_hits",
    f"""WITH {_PARSED}, {_SUB_SQL}, s AS (
  SELECT b.conv_id, b.turn, b.call_no, b.sub_no, b.sub_query, b.topk, c.vec_id AS clip_no, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM subs b JOIN embeddings a ON a.vec_id = {_CODE} JOIN embeddings c ON c.label = b.conv_id % 10 WHERE b.tool = '{_RETRIEVE}'
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, call_no, sub_no ORDER BY round(score, 12) DESC, clip_no) AS rank FROM s)
SELECT conv_id, turn, CAST(call_no AS INTEGER) AS call_no, CAST(sub_no AS INTEGER) AS sub_no, sub_query, string_agg(clip_no, ',' ORDER BY rank) AS clips FROM r WHERE rank <= topk GROUP BY 1, 2, 3, 4, 5""",
)
def tool_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sub-query of a textual retriever call with the topk clips of the conversation's video, best first."""
    from temporis.plans.engine import Engine

    calls = _scoped_calls(spark, sf_dir, _RETRIEVE)
    hits = Engine(spark, Settings()).segment_hits(calls, schemas.clip_vectors(spark, sf_dir), _encoded(spark, sf_dir, calls))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "clip_no")))
    clips = F.array_join(F.transform(ordered, lambda x: x["clip_no"].cast("string")), ",")
    return hits.groupBy("conv_id", "turn", "call_no", "sub_no", "sub_query").agg(clips.alias("clips"))


@query(
    "tool5_subtitle_results",
    f"""WITH {_PARSED}, {_SUB_SQL}, s AS (
  SELECT b.conv_id, b.turn, b.call_no, b.sub_no, b.body, b.topk, c.vec_id AS seq, c.vec_id // 4 AS start_s, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM subs b JOIN embeddings a ON a.vec_id = {_CODE} JOIN embeddings c ON c.label = b.conv_id % 10 WHERE b.tool = '{_SUBS}'
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, call_no, sub_no ORDER BY round(score, 12) DESC, seq) AS rank FROM s
), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, call_no, start_s ORDER BY sub_no, rank) AS n FROM r WHERE rank <= topk
), t AS (SELECT conv_id, turn, call_no, body, string_agg(start_s || '-' || (start_s + 3) || ' ' || seq, '; ' ORDER BY start_s) AS found FROM u WHERE n = 1 GROUP BY 1, 2, 3, 4)
SELECT conv_id, turn, string_agg('The tool results for <{_SUBS}>' || body || '</{_SUBS}> are:' || chr(10) || found || chr(10), '' ORDER BY call_no) AS tool_result, CAST(1 AS BIGINT) AS n_tools FROM t GROUP BY 1, 2""",
)
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle retriever calls as the model is told of them: the topk subtitles of each sub-query, those that start together once, in order of start."""
    from temporis.plans.engine import Engine

    calls = _scoped_calls(spark, sf_dir, _SUBS)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("seq"), "embedding")
    timed = vectors.select("video_id", "seq", F.expr("seq div 4").alias("start_s"), F.expr("seq div 4 + 3").alias("end_s"), F.col("seq").cast("string").alias("text"))
    hits = Engine(spark, Settings()).subtitle_hits(calls, timed, vectors, _encoded(spark, sf_dir, calls))
    said = F.concat(F.col("start_s").cast("string"), F.lit("-"), F.col("end_s").cast("string"), F.lit(" "), F.col("text"))
    found = hits.groupBy("conv_id", "turn", "call_no", "body").agg(F.array_sort(F.collect_list(F.struct("start_s", said.alias("x")))).alias("all"))
    told = toolcall.result_text(F.lit(_SUBS), F.col("body"), F.array_join(F.transform("all", lambda x: x["x"]), "; "))
    done = toolcall.results(found.select("conv_id", "turn", "call_no", F.lit(4).alias("priority"), F.lit(_SUBS).alias("tool"), told.alias("result")))
    return done.select("conv_id", "turn", "tool_result", F.size("tools").cast("long").alias("n_tools"))


@query(
    "tool4_image_query",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
  q AS (SELECT DISTINCT conv_id, conv_id * 10 AS t, 2 + conv_id % 3 AS topk FROM conversations),
  s AS (SELECT q.conv_id, q.t, q.topk, c.vec_id AS clip_no, list_inner_product(a.e, c.e) / (a.n * c.n) AS score FROM q JOIN v a ON a.vec_id = q.conv_id JOIN v c ON true),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, clip_no) AS rank FROM s)
SELECT conv_id, clip_no, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= topk + 1 AND NOT (clip_no * 10 <= t AND t <= clip_no * 10 + 10)""",
)
def tool_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation asks by the frame of the clip of its number, for as many clips as its call says."""
    from temporis.operators.retrieval import image_search

    ask = F.concat(F.lit(f"<{_IMAGE}>"), (F.col("conv_id") * 10).cast("string"), F.lit(f".0</{_IMAGE}><topk>"), (2 + F.col("conv_id") % 3).cast("string"), F.lit("</topk>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.lit(0).alias("turn"), ask.alias("text"))
    calls = toolcall.parse(rows).where(F.col("tool") == _IMAGE).select(F.col("conv_id").alias("query_id"), F.col("body").try_cast("double").alias("t"), "topk")
    clips = schemas.clip_vectors(spark, sf_dir).select("clip_no", "embedding")
    queries = calls.join(clips.select(F.col("clip_no").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    return image_search(queries, clips).select(F.col("query_id").alias("conv_id"), "clip_no", "rank")


@query(
    "tool6_extractor",
    f"WITH {schemas.SUBTITLES_SQL}, {_PARSED}, p AS (SELECT conv_id, turn, unnest(string_split(body, ';')) AS part FROM calls WHERE tool = 'subtitle_extractor'), r AS (SELECT conv_id, turn, CAST(split_part(part, ':', 1) AS DOUBLE) AS b, CAST(split_part(part, ':', 2) AS DOUBLE) AS e FROM p) SELECT r.conv_id, r.turn, s.seq, CAST(floor(s.start_s) AS BIGINT) AS start_s FROM r JOIN subtitles s ON s.video_id = r.conv_id AND s.start_s BETWEEN r.b AND r.e",
)
def tool_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = toolcall.parse(_spoken(spark, sf_dir)).where("tool = 'subtitle_extractor'")
    asked = toolcall.ranges(calls, several=True).withColumnRenamed("end_s", "until_s")
    joined = asked.join(schemas.subtitles(spark, sf_dir), F.col("conv_id") == F.col("video_id"))
    return joined.where(F.col("start_s").between(F.col("begin_s"), F.col("until_s"))).select("conv_id", "turn", "seq", F.col("start_s").cast("long").alias("start_s"))


@query("str5_after_thinking", f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN contains(text, '</thinking>') THEN split_part(text, '</thinking>', 2) ELSE text END AS text FROM turns")
def str_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.after_thinking(F.col("text")).alias("text"))


@query("str6_tag_bodies", f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '(?s)<topk>(.*?)</topk>', 1), '|') AS topks FROM turns WHERE role = 'assistant'")
def str_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("conv_id", "turn", F.array_join(T.tag_bodies(F.col("text"), "topk"), "|").alias("topks"))


@query("str9_answer_letter", f"WITH {_TURNS}, a AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s)<answer>(.*?)</answer>', 1) AS b FROM turns WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN len(b) = 0 OR regexp_extract(b[-1], '[A-Z]') = '' THEN '-' ELSE regexp_extract(b[-1], '[A-Z]') END AS letter FROM a")
def str_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("conv_id", "turn", T.answer_letter(F.col("text")).alias("letter"))


@query("str7_lists", "SELECT doc_id, doc_id % 7 || ';' || doc_id % 5 || '; 1;x' AS body, CASE WHEN doc_id % 7 <= doc_id % 5 THEN doc_id % 7 || ',' || doc_id % 5 ELSE doc_id % 5 || ',' || doc_id % 7 END AS clips FROM documents")
def str_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws(";", (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 5).cast("string"), F.lit(" 1"), F.lit("x"))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return rows.withColumn("clips", F.array_join(T.clip_numbers(F.col("body")).cast("array<string>"), ","))


@query("str10_whole_numbers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS INTEGER) WHEN 1 THEN NULL WHEN 2 THEN -3 ELSE NULL END AS k FROM documents")
def str_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    said = F.when(d % 4 == 0, F.concat(F.lit(" "), d.cast("string"), F.lit(" "))).when(d % 4 == 1, F.lit("1.5")).when(d % 4 == 2, F.lit("-3")).otherwise(F.lit("many"))
    return table(spark, sf_dir, "documents").select("doc_id", T.whole_number(said).alias("k"))


@query("str11_templates", "SELECT item_id, 'Video ' || item_id || ': ' || text || ' Answer in ' || item_id % 3 || ' words.' AS prompt FROM benchmark")
def str_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = T.fill("Video {video}: {question} Answer in {n} words.", video=F.col("item_id"), question=F.col("text"), n=F.col("item_id") % 3)
    return table(spark, sf_dir, "benchmark").select("item_id", filled.alias("prompt"))


REPLAY_SQL = (
    _TURNS
    + """, n AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS round_no,
    contains(text, '<video_reader_question>') OR contains(text, '<video_segment_retriever_textual_query>') OR contains(text, '<subtitle_retriever>') OR contains(text, '<subtitle_extractor>') AS has_tool FROM turns),
  e AS (SELECT *, min(CASE WHEN role = 'assistant' AND contains(text, '<answer>') AND round_no < 20 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM n),
  l AS (SELECT * FROM e WHERE (stop IS NULL OR turn <= stop) AND round_no < 20)"""
)


@query("loop9_replay", f"WITH {REPLAY_SQL} SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS rounds, coalesce(max(CASE WHEN turn = stop THEN regexp_extract(regexp_extract(text, '<answer>(.*)</answer>', 1), '[A-Z]') END), 'No final answer provided within maximum rounds') AS answer, count(*) AS n_messages, CAST(count_if(role = 'assistant' AND has_tool) AS BIGINT) AS tool_turns FROM l GROUP BY conv_id")
def loop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.replay(turns(spark, sf_dir))


@query("loop2_acceptance", f"WITH {REPLAY_SQL} SELECT conv_id, turn, contains(text, '<answer>') AS demo, contains(text, '<answer>') AND NOT has_tool AS evaluation FROM e WHERE role = 'assistant'")
def loop_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).select("conv_id", "turn", agent.accepted(F.col("text")).alias("demo"), agent.accepted(F.col("text"), True).alias("evaluation"))


@query("loop3_replies", f"WITH {REPLAY_SQL} SELECT conv_id, turn, CASE WHEN has_tool THEN 'found' || chr(10) || 'You have ' || (20 - round_no - 1) || ' rounds remaining. Please make the most of each opportunity!' WHEN round_no >= 18 THEN 'Maximum rounds reached! Please provide your final answer in <answer></answer> format!' ELSE 'Invalid output format! Please use the provided XML format for tools or provide final answer in <answer></answer>.' END AS reply FROM e WHERE role = 'assistant'")
def loop_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = _spoken(spark, sf_dir).withColumn("round_no", F.row_number().over(order) - 1)
    found = F.when(agent.has_tool(F.col("text")), F.lit("found"))
    return rows.select("conv_id", "turn", agent.reply(F.col("text"), found, F.col("round_no")).alias("reply"))


@query("loop4_rounds_left", f"WITH {REPLAY_SQL} SELECT conv_id, turn, CAST(20 - round_no - 1 AS INTEGER) AS rounds_left FROM e WHERE role = 'assistant'")
def loop_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return _spoken(spark, sf_dir).select("conv_id", "turn", agent.rounds_left(F.row_number().over(order) - 1).alias("rounds_left"))


#: Stand-ins of the live loop: a conversation is about the video of its number's last digit; a text's vector is the row numbered by its first character's code
#: and its length; what is seen at a second, the row of that number; a subtitle lasts three seconds, from a quarter of its number on.
_TEXT_ROW = "(ascii({0}) + 37 * length({0})) % 500"


class _ReadsResults:
    """A model that asks all tools about its video, then breaks the form, then answers by the first clip that it was told of."""

    def __call__(self, prompt: str) -> str:
        rounds, n = prompt.count("\nassistant: "), int(prompt.removeprefix("user: video ")[0])
        if rounds == 0:
            return (
                f"<thinking>all</thinking><video_reader>{n};3</video_reader><video_reader_question>who?</video_reader_question><video_browser_question>what happens?</video_browser_question>"
                f"<{_RETRIEVE}>red car;dog {n}</{_RETRIEVE}><topk>3</topk><{_IMAGE}>{10 * n}.0</{_IMAGE}><{_SUBS}>who;where</{_SUBS}><subtitle_extractor>0:60;90:120;never</subtitle_extractor>"
            )
        return "no format" if rounds == 1 else f"<answer>({_letter(prompt)})</answer>"


def _letter(prompt: str) -> str:
    """By the first number in the first list of clips that the prompt holds."""
    told = prompt.partition("are:\n[")[2]
    number = told.partition("]")[0].partition(",")[0]
    return chr(65 + int(number) % 4) if number else "-"


class _Answers:
    """An evaluated model: an answer beside a tool call, which isn't taken, then the letter of what it was told."""

    def __call__(self, prompt: str) -> str:
        if "\nassistant: " not in prompt:
            return f"<answer>A</answer><{_RETRIEVE}>Q{len(prompt)}</{_RETRIEVE}>"
        return f"<answer>option ({_letter(prompt)})</answer>"


def _sees(parts) -> str:
    """A vision model that says what it was shown."""
    shown = [p["value"] for p in parts if p["type"] == "text"][:-1]
    return f"{sum(p['type'] == 'image_url' for p in parts)} frames, {shown[0]} to {shown[-1]}"


def toolbox(spark: SparkSession, sf_dir: str, subjects: DataFrame):
    """The tools over the stand-ins. subjects: conv_id, video_id, question."""
    from temporis.plans import saving
    from temporis.plans.engine import Engine
    from temporis.plans.toolbox import Toolbox

    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), "vec_id", "embedding")
    seq = F.col("vec_id")
    text = F.concat(F.when(seq % 3 == 0, "it's ").otherwise("line "), seq.cast("string"))
    subtitles = vectors.select("video_id", seq.alias("seq"), F.expr("cast(vec_id div 4 as double)").alias("start_s"), F.expr("cast(vec_id div 4 + 3 as double)").alias("end_s"), text.alias("text"))
    row = ((F.ascii("text") + 37 * F.length("text")) % 500).cast("long")
    encode = lambda texts: texts.select("text", row.alias("vec_id")).join(vectors.select("vec_id", F.col("embedding").alias("query")), "vec_id").drop("vec_id")
    second = (F.col("t") % 500).cast("long")
    moments = lambda rows: rows.withColumn("vec_id", second).join(vectors.select("vec_id", F.col("embedding").alias("video_query")), "vec_id").drop("vec_id")
    return Toolbox(
        Engine(spark, Settings()), subjects, schemas.videos(spark, sf_dir), schemas.frames(spark, sf_dir).select("video_id", "t_s", "frame_no", "is_valid"),
        vectors.withColumnRenamed("vec_id", "clip_no"), subtitles, vectors.withColumnRenamed("vec_id", "seq"), encode, moments, _sees, saving.saver(spark), saving.drop,
    )


def _shown_sql(points: str) -> str:
    """What the vision stand-in says of the points (v, k, t) whose nearest frame is readable."""
    return f"""(SELECT v, CASE WHEN m > 32 THEN 32 WHEN m < 10 THEN 10 ELSE m END || ' frames, [' || l[1] || ' second] to [' ||
    l[CAST(CASE WHEN m > 32 THEN floor(31 * (m / 32.0::DOUBLE)) WHEN m < 10 THEN floor(9 * (m / 10.0::DOUBLE)) ELSE m - 1 END AS BIGINT) + 1] || ' second]' AS said
  FROM (SELECT v, list(t ORDER BY t, t_s) AS l, count(*) AS m FROM (
    SELECT p.v, p.t, f.t_s, f.is_valid, row_number() OVER (PARTITION BY p.v, p.k, p.t ORDER BY abs(f.t_s - p.t), f.t_s, f.frame_no) AS n FROM {points} p JOIN frames f ON f.video_id = p.v
  ) WHERE n = 1 AND is_valid GROUP BY v))"""


def _hits_sql(text: str) -> str:
    """v, told: the three clips of a video that are nearest to the text's vector."""
    return f"""(SELECT v, '[' || string_agg(clip, ', ' ORDER BY rank) || ']' AS told FROM (
    SELECT x.v, c.vec_id AS clip, row_number() OVER (PARTITION BY x.v ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC, c.vec_id) AS rank
    FROM (SELECT v, {text} AS s FROM about) x JOIN embeddings a ON a.vec_id = {_TEXT_ROW.format("s")} JOIN embeddings c ON c.label = x.v) WHERE rank <= 3 GROUP BY v)"""


_TIMED_SQL = """timed AS (SELECT label AS v, vec_id AS seq, vec_id // 4 AS b, vec_id // 4 + 3 AS e, CASE WHEN vec_id % 3 = 0 THEN '"it''s ' || vec_id || '"' ELSE '''line ' || vec_id || '''' END AS said, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def _range_sql(b: int, e: int) -> str:
    said = "string_agg('{''begin_timestamp'': ' || b || ', ''end_timestamp'': ' || e || ', ''subtitle'': ' || said || '}', ', ' ORDER BY b, seq)"
    return f"(SELECT a.v, '[' || coalesce((SELECT {said} FROM timed t WHERE t.v = a.v AND b BETWEEN {b} AND {e}), '') || ']' AS told FROM about a)"


def _told_sql(tool: str, body: str, found: str) -> str:
    return f"'The tool results for <{tool}>' || {body} || '</{tool}> are:' || chr(10) || {found} || chr(10)"


_LIVE = f"""WITH {schemas.VIDEOS_SQL}, {_TIMED_SQL},
talks AS (SELECT conv_id, conv_id % 10 AS v, 'video ' || conv_id % 10 || ': ' || arg_min(text, turn) AS question FROM conversations GROUP BY conv_id),
about AS (SELECT DISTINCT v FROM talks),
read_points AS (SELECT v, k, (CASE k WHEN 0 THEN v ELSE 3 END) * 10.0::DOUBLE + i * 0.5 AS t FROM about, range(2) a(k), range(20) b(i)),
seen_points AS (SELECT v, 0 AS k, i * 0.5::DOUBLE AS t FROM (SELECT video_id AS v, unnest(range(CAST(floor((CASE WHEN duration < 1 THEN duration + 0.5 ELSE duration END) * 2) AS BIGINT))) AS i FROM videos WHERE video_id IN (SELECT v FROM about))),
readers AS (SELECT v, 'The tool result of <video_reader>' || v || ';3</video_reader> is:' || chr(10) || ' ' || said || chr(10) AS told FROM {_shown_sql("read_points")}),
browsers AS (SELECT v, 'The tool result of <video_browser_question>what happens?</video_browser_question> is:' || chr(10) || ' ' || said || chr(10) AS told FROM {_shown_sql("seen_points")}),
cars AS {_hits_sql("'red car'")}, dogs AS {_hits_sql("'dog ' || v")},
image_scores AS (
  SELECT q.conv_id, q.v, c.vec_id AS clip, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) + list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
  FROM talks q JOIN embeddings a ON a.vec_id = 10 * q.v JOIN embeddings b ON b.vec_id = {_TEXT_ROW.format("q.question")} JOIN embeddings c ON c.label = q.v),
image_ranks AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, clip) AS rank FROM image_scores),
images AS (SELECT q.conv_id, '[' || coalesce(string_agg(clip, ', ' ORDER BY rank), '') || ']' AS told FROM talks q LEFT JOIN image_ranks r ON r.conv_id = q.conv_id AND rank <= 4 AND NOT (clip * 10 <= 10 * q.v AND 10 * q.v <= clip * 10 + 10) GROUP BY q.conv_id),
sub_scores AS (SELECT a.v, n, seq, b, e, said, row_number() OVER (PARTITION BY a.v, n ORDER BY round(list_inner_product(CAST(m.embedding AS DOUBLE[]), x), 12) DESC, seq) AS rank
  FROM about a, (VALUES (0, 'who'), (1, 'where')) w(n, s) JOIN embeddings m ON m.vec_id = {_TEXT_ROW.format("s")} JOIN timed t ON t.v = a.v),
sub_firsts AS (SELECT *, row_number() OVER (PARTITION BY v, b ORDER BY n, rank) AS first FROM sub_scores WHERE rank <= 3),
subs AS (SELECT v, '[' || string_agg('{{''begin_timestamp'': ' || CAST(b AS DOUBLE) || ', ''end_timestamp'': ' || CAST(e AS DOUBLE) || ', ''text'': ' || said || '}}', ', ' ORDER BY b, n, rank) || ']' AS told FROM sub_firsts WHERE first = 1 GROUP BY v),
told AS (SELECT q.conv_id, cars.told AS first, concat(readers.told, browsers.told, {_told_sql(_RETRIEVE, "'red car'", "cars.told")}, {_told_sql(_RETRIEVE, "'dog ' || q.v", "dogs.told")}, {_told_sql(_IMAGE, "10 * q.v || '.0'", "images.told")},
  {_told_sql(_SUBS, "'who;where'", "subs.told")}, {_told_sql("subtitle_extractor", "'0:60'", "early.told")}, {_told_sql("subtitle_extractor", "'90:120'", "later.told")}) AS tool_result
  FROM talks q LEFT JOIN readers USING (v) LEFT JOIN browsers USING (v) JOIN cars USING (v) JOIN dogs USING (v) JOIN images USING (conv_id) JOIN subs USING (v) JOIN {_range_sql(0, 60)} early USING (v) JOIN {_range_sql(90, 120)} later USING (v))
SELECT conv_id, CAST(3 AS BIGINT) AS rounds, chr(CAST(65 + CAST(regexp_extract(first, '[0-9]+') AS BIGINT) % 4 AS INTEGER)) AS answer, CAST(6 AS BIGINT) AS n_messages, tool_result || chr(10) || 'You have 19 rounds remaining. Please make the most of each opportunity!' AS told FROM told"""


@query("loop1_live_rounds", _LIVE)
def loop_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations through the live loop: a turn that calls all six tools, a turn without form, then an answer by what the tools told."""
    from temporis.plans import saving

    start = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    video = (F.col("conv_id") % 10).cast("long")
    start = start.select("conv_id", F.concat(F.lit("video "), video.cast("string"), F.lit(": "), "text").alias("text"))
    tools = toolbox(spark, sf_dir, start.select("conv_id", video.alias("video_id"), F.col("text").alias("question")))
    log = agent.run_rounds(start, _ReadsResults(), tools, saving.saver(spark), drop=saving.drop)
    told = log.where("turn = 2").select("conv_id", F.col("text").alias("told"))
    return agent.replay(log).join(told, "conv_id").select("conv_id", "rounds", "answer", "n_messages", "told")


@query(
    "eval4_run",
    f"""WITH q AS (SELECT item_id, item_id % 10 AS v, 'user: Q: ' || text AS prompt, CASE WHEN item_id % 2 = 0 THEN 'count' ELSE 'order' END AS task, chr(CAST(65 + item_id % 4 AS INTEGER)) AS gold FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)),
  s AS (SELECT q.*, c.vec_id AS clip, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC, c.vec_id) AS rank
    FROM q JOIN embeddings a ON a.vec_id = {_TEXT_ROW.format("('Q' || length(prompt))")} JOIN embeddings c ON c.label = q.v)
SELECT task, count(*) AS n, round(avg(CASE WHEN gold = chr(CAST(65 + clip % 4 AS INTEGER)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM s WHERE rank = 1 GROUP BY 1""",
)
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation from questions to accuracy: those answered before (labelled numbers) are skipped, the others go through the rounds with the tools, an answer
    beside a tool call isn't taken, and the letter, which follows from what the tools told, is scored against the gold one."""
    from temporis.plans import saving

    i = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(i.alias("item"), F.concat(F.lit("Q: "), F.col("text")).alias("question"), i.cast("string").alias("video_path"), F.when(i % 2 == 0, "count").otherwise("order").alias("task"), F.char(65 + i % 4).alias("gold"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item")).join(asked, "item").select("question", "video_path")
    left = validity.unprocessed(asked, done)
    start = left.select(F.col("item").alias("conv_id"), F.col("question").alias("text"))
    tools = toolbox(spark, sf_dir, start.select("conv_id", (F.col("conv_id") % 10).alias("video_id"), F.col("text").alias("question")))
    log = agent.run_rounds(start, _Answers(), tools, saving.saver(spark), evaluation=True, drop=saving.drop)
    answers = agent.replay(log, evaluation=True).select(F.col("conv_id").alias("item"), "answer")
    scored = left.join(answers, "item").withColumn("score", evaluate.score(F.col("answer"), F.col("gold")))
    return evaluate.accuracy(scored, ["task"])


@query("loop8_step_events", f"WITH {_PARSED}, b AS (SELECT conv_id, turn, priority, call_no, tool, s AS status FROM calls, (VALUES ('started'), ('completed')) v(s)) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, priority, call_no, status DESC) AS seq, status, tool FROM b")
def loop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.step_events(toolcall.parse(_spoken(spark, sf_dir))).select("conv_id", "seq", "status", "tool")


@query("loop10_prompt_choice", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'with_subtitles' WHEN lang = 'en' THEN 'english' WHEN lang IS NOT NULL THEN 'of ' || lang ELSE 'plain' END AS prompt FROM documents")
def loop_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language is the dataset, each known one with a prompt of its own."""
    rows = table(spark, sf_dir, "documents")
    known = {"en": "english"} | {lang: f"of {lang}" for lang in ("de", "fr", "es")}
    return rows.select("doc_id", agent.prompt_choice(F.col("doc_id") % 2 == 0, F.col("lang"), known, "with_subtitles", "plain").alias("prompt"))


@query(
    "loop11_frame_content",
    f"""WITH {schemas.FRAMES_SQL}, f AS (SELECT video_id, frame_no, floor(t_s) + 0.5 AS t FROM frames)
SELECT video_id, CAST(2 * count(*) + 1 AS INTEGER) AS parts, sha256(string_agg('text:[' || CAST(t AS BIGINT) - 1 || '.5 second]|image_url:' || frame_no || '|', '' ORDER BY t, frame_no) || 'text:q') AS content FROM (SELECT video_id, frame_no, t + 0.5 AS t FROM f) GROUP BY 1""",
)
def loop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message about all frames of each video, told by a digest: each frame after its time, then the question."""
    ordered = F.array_sort(F.collect_list(F.struct((F.floor("t_s") + F.lit(0.5)).alias("t"), "frame_no")))
    rows = schemas.frames(spark, sf_dir).groupBy("video_id").agg(ordered.alias("x"))
    content = agent.frame_content(F.transform("x", lambda s: s["frame_no"].cast("string")), F.transform("x", lambda s: s["t"]), F.lit("q"))
    done = rows.select("video_id", content.alias("c"))
    said = F.array_join(F.transform("c", lambda p: F.concat_ws(":", p["type"], p["value"])), "|")
    return done.select("video_id", F.size("c").alias("parts"), F.sha2(said, 256).alias("content"))


@query("win3_last_user", "SELECT conv_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def win_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_user_message(table(spark, sf_dir, "conversations"))


@query("agg7_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def agg_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.joined_turns(table(spark, sf_dir, "conversations"))


@query("agg3_summary", "SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS rounds, count(*) AS messages, CAST(max(length(text)) AS INTEGER) AS longest FROM conversations GROUP BY 1")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(table(spark, sf_dir, "conversations"))


@query("agg4_hours_left", "SELECT event_id, round(value * 10 / (event_id + 1) * ((SELECT count(*) FROM events) - event_id - 1) / 3600, 6) AS hours FROM events")
def agg_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, done = table(spark, sf_dir, "events"), F.col("event_id") + 1
    return rows.select("event_id", F.round(evaluate.hours_left(F.col("value") * 10, done, F.lit(rows.count())), 6).alias("hours"))


@query("agg8_tools_used", f"WITH {_PARSED} SELECT conv_id, count(DISTINCT tool) AS n_tools, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM calls GROUP BY 1")
def agg_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcall.parse(_spoken(spark, sf_dir)).groupBy("conv_id").agg(F.count_distinct("tool").alias("n_tools"), F.sum(F.length("body")).alias("n_chars"))


@query("agg9_answers_by_conversation", f"WITH {_PARSED} SELECT conv_id, string_agg(body, ' / ' ORDER BY turn, priority, call_no) AS answers FROM calls GROUP BY 1")
def agg_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "priority", "call_no", "body")))
    return toolcall.parse(_spoken(spark, sf_dir)).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), " / ").alias("answers"))


@query("join4_positional", f"WITH {_PARSED} SELECT c.conv_id, c.turn, CAST(c.call_no AS INTEGER) AS call_no, c.body, u.text AS answer FROM calls c LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1 WHERE c.tool = '{_SUBS}'")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = toolcall.parse(_spoken(spark, sf_dir)).where(F.col("tool") == _SUBS).select("conv_id", "turn", "call_no", "body")
    after = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(0).alias("call_no"), F.col("text").alias("answer"))
    return toolcall.answers_by_call(calls, after)


#: A question is a whole text; a labelled document is an answered one.
_QA = "q AS (SELECT doc_id AS item, text AS question, source AS video_path FROM documents), a AS (SELECT DISTINCT question, video_path FROM q WHERE item IN (SELECT doc_id FROM labels))"


def _qa(spark: SparkSession, sf_dir: str, digest: bool = True) -> tuple[DataFrame, DataFrame]:
    """Questions and answered ones, told by a digest of the whole text, or by the text itself."""
    key = F.sha2("text", 256) if digest else F.col("text")
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), key.alias("question"), F.col("source").alias("video_path"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"))
    return q, q.join(labelled, "item", "left_semi").select("question", "video_path").distinct()


@query("join6_cached_semi", f"WITH {_QA} SELECT DISTINCT question, video_path FROM q WHERE (question, video_path) IN (SELECT question, video_path FROM a)")
def join_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are cached, the labelled ones asked for."""
    q, a = _qa(spark, sf_dir, digest=False)
    return validity.cached_for(q.select("question", "video_path").distinct(), a)


@query("join7_resume_anti", f"WITH {_QA} SELECT item FROM q ANTI JOIN a USING (question, video_path)")
def join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = _qa(spark, sf_dir)
    return validity.unprocessed(q, a).select("item")


@query("eval2_resume_literal", f"WITH {_QA} SELECT item FROM q WHERE question NOT IN (SELECT question FROM a)")
def eval_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = _qa(spark, sf_dir)
    return validity.unprocessed(q, a, "literal").select("item")


@query("set2_distinct_calls", "SELECT conv_id, role AS query, turn % 2 AS match_set, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3")
def set_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("query"), (F.col("turn") % 2).alias("match_set"), "turn", F.lit(0).alias("call_no"))
    return validity.distinct_calls(calls).select("conv_id", "query", "match_set", "turn")


@query("eval1_shard", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) FROM documents) // 16 + 1) AS INTEGER) AS shard FROM documents")
def eval_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from temporis.plans.saving import saver

    return evaluate.shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 16, saver(spark))


@query("eval3_score", "SELECT l.doc_id, CASE WHEN d.lang = '' THEN false ELSE substr(d.lang, 1, 1) = CASE WHEN l.quality = 1 THEN 'e' ELSE 'f' END END AS score FROM labels l JOIN documents d USING (doc_id)")
def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", evaluate.score(F.col("lang"), F.when(F.col("quality") == 1, "e").otherwise("f")).alias("score"))


@query("agg5_accuracy", "SELECT d.source, d.lang, count(*) AS n, round(avg(CAST(l.quality AS DOUBLE)), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def agg_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("score", F.col("quality") == 1)
    return evaluate.accuracy(rows, ["source", "lang"])


@query("jsn1_results", "SELECT doc_id, quality, toxic FROM labels")
def jsn_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from temporis.sources.files import results_json

    written = results_json(table(spark, sf_dir, "labels"))
    return written.select(F.from_json("value", "doc_id long, quality int, toxic int").alias("x")).select("x.*")


@query("jsn2_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def jsn_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("map1_dispatch", "SELECT doc_id, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'audio' ELSE 'none' END AS encoder FROM documents")
def map_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit("en"), F.lit("text"), F.lit("de"), F.lit("audio"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(known, F.col("lang")), F.lit("none")).alias("encoder"))

"""Golden cases and properties of the engine's rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from temporis.functions import numeric, text, timecode, vector
from temporis.operators import agent, evaluate, interval, retrieval, sample, segment, toolcall
from temporis.plans.engine import Engine
from temporis.plans.plugins import HashingEncoder, as_map, encode_modalities, scripted_model
from temporis.plans.saving import saver
from temporis.sources import files, subtitles

SRT = (
    '1\r\n00:00:01,500 --> 00:00:04,250\r\n<font color="white" size=".72c">hello there</font>\r\n\r\n'
    "2\r\n00:01:00,000 --> 00:01:02,000\r\nplain\r\ntwo lines\r\n\r\n3\r\nshort\r\n\r\n4\r\n00:00:0x,1 --> 00:00:02,5\r\nbad\r\n\r\n5\r\n00:00:05,5 --> 00:00:06,000\r\nlate\r\n\r\n"
)


def value(spark, column, **fields):
    row = spark.range(1).withColumns({k: F.lit(v) for k, v in fields.items()}) if fields else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_srt(spark):
    files_ = spark.createDataFrame([("v", SRT)], "video_id string, content string")
    got = [(r.start_s, r.end_s, r.text, r.status) for r in subtitles.parse_srt(files_).orderBy("seq").collect()]
    assert got == [(1.5, 4.25, "hello there", "ok"), (60.0, 62.0, "plain two lines", "ok"), (None, 2.005, "bad", "malformed"), (5.005, 6.0, "late", "ok")]
    with pytest.raises(Exception, match="malformed subtitle block"):
        subtitles.parse_srt(files_, strict=True).collect()


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "srt").mkdir()
    (tmp_path / "json").mkdir()
    (tmp_path / "srt/a.srt").write_text(SRT)
    for name in ("a", "b"):
        (tmp_path / f"json/{name}_en.json").write_text('[{"start":"00:00:01,500","end":"00:00:04,250","line":"hello"}]')
    got = subtitles.read(spark, str(tmp_path / "srt"), str(tmp_path / "json")).groupBy("video_id").count().orderBy("video_id").collect()
    assert [tuple(r) for r in got] == [("a", 4), ("b", 1)]
    assert {r.name for r in files.list_files(spark, str(tmp_path), "*.json").collect()} == {"a_en.json", "b_en.json"}


def test_questions(spark, tmp_path):
    one = '{"video_id":"v1","question":"What falls?","correct_choice":1,"options":["A.cup","B.hat"],"answer":"B","duration":563.37,"task":"TAA"}'
    (tmp_path / "list.json").write_text(f"[{one},{one}]")
    (tmp_path / "lines.json").write_text(f"{one}\n{one}\n{one}\n")
    assert files.read_questions(spark, str(tmp_path / "list.json")).count() == 2
    assert files.read_questions(spark, str(tmp_path / "lines.json")).first().options == ["A.cup", "B.hat"]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, [1.0, 2.0], 10, "a"), ("v", 1, [1.0, 3.0], 10, "b")], "video_id string, clip_no int, embedding array<float>, clip_duration int, encoder string")
    files.save_vectors(rows, str(tmp_path / "e"))
    assert files.load_vectors(spark, str(tmp_path / "e"), 10, "a").count() == 1
    for _ in range(2):
        files.append_results(rows.select("video_id", "clip_no"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    files.Settings(clip_duration=7).store(spark)
    assert files.Settings.load(spark).clip_duration == 7 and files.examples(spark).count() == 3
    files.Settings().store(spark)


def test_media_plugins(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"12345")
    (tmp_path / "b.mp4").write_bytes(b"?")
    got = files.probe_media(spark, str(tmp_path), lambda c: {"duration": float(len(c)), "fps": 2.0, "width": 4, "height": 3} if len(c) > 1 else None)
    assert {(r.video_id, r.duration, r.status) for r in got.collect()} == {("a", 5.0, "ok"), ("b", None, "failed")}
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert files.decode_media(raw, lambda p, c: [(p, k) for k in c], "path string, x int").count() == 6


@pytest.mark.parametrize(("name", "want"), [("clip_7_00-01-10_to_00-01-20.mp4", (7, 70.0, 80.0)), ("clip_0_10-00-00_to_10-00-10.mp4", (0, 36000.0, 36010.0)), ("other.mp4", (None, None, None))])
def test_clip_names(spark, name, want):
    got = value(spark, timecode.parse_clip_name(F.lit(name)))
    assert tuple(got) == want
    if want[0] is not None:
        assert value(spark, timecode.clip_name(F.lit(want[0]), F.lit(want[1]), F.lit(want[2]))) == name


def test_names_and_paths(spark):
    assert value(spark, timecode.parse_frame_name(F.lit("frame_12.500.jpg"))) == 12.5 and value(spark, timecode.parse_frame_name(F.lit("frame_12.png"))) == 12.0
    assert value(spark, timecode.frame_name(F.lit(12.5))) == "frame_12.500.jpg"
    assert value(spark, timecode.stem(F.lit("/a/b.c.mp4"))) == "b" and value(spark, timecode.stem(F.lit("/a/b.c.mp4"), False)) == "b.c"


@pytest.mark.parametrize(("duration", "n", "end"), [(95.0, 10, 95.0), (100.0, 10, 100.0), (0.5, 1, 0.5), (0.0, 0, None)])
def test_grid_tiles_the_video(spark, duration, n, end):
    rows = segment.clip_grid(spark.createDataFrame([("v", duration)], "video_id string, duration double")).orderBy("clip_no").collect()
    assert len(rows) == n and (not rows or rows[-1].end_s == end)
    assert all(a.end_s == b.start_s for a, b in zip(rows, rows[1:], strict=False))


def test_strict_completeness(spark):
    expected = spark.createDataFrame([("v", k) for k in range(6)], "video_id string, clip_no int")
    clips = spark.createDataFrame([("v", k, k < 3) for k in range(6)], "video_id string, clip_no int, is_valid boolean")
    assert segment.completeness(expected, clips).first().is_complete is False
    with pytest.raises(Exception, match="too few valid clips"):
        segment.completeness(expected, clips, strict=True).collect()


def test_points(spark):
    assert value(spark, sample.interval_points(F.lit(75.0), F.lit(75.0))) == [74.5, 75.0]
    assert value(spark, sample.interval_points(F.lit(0.2), F.lit(0.3))) == [0.0]
    assert value(spark, sample.clip_points(F.lit(2), 10, 1)) == [20.0 + k for k in range(10)]
    assert [value(spark, numeric.source_frame(F.lit(t), F.lit(1.0))) for t in (0.5, 1.5, 2.5)] == [0, 2, 2]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 31, 32, 33, 63, 64, 100])
def test_thinning(spark, n):
    frames = F.lit(list(range(n))).cast("array<int>")
    step = max(1, n // 32)
    assert value(spark, sample.stride(frames)) == list(range(n))[::step][:32]
    assert value(spark, sample.uniform(frames)) == ([int(i * n / 32) for i in range(32)] if n > 32 else list(range(n)))
    assert value(spark, sample.repeated(frames)) == ([int(i * n / 10) for i in range(10)] if 0 < n < 10 else list(range(n)))


def test_no_frames_is_an_error(spark):
    with pytest.raises(Exception, match="no frames"):
        value(spark, sample.required(F.expr("cast(array() as array<double>)")))


def test_intervals(spark):
    c = lambda s, e: tuple(value(spark, interval.clamp(F.lit(s), F.lit(e), F.lit(10.0))))
    assert c(-3.0, 4.0) == (0.0, 4.0) and c(12.0, 15.0) == (9.0, 10.0) and c(-5.0, -1.0) == (-1.0, 0.0)


def test_overlap_join_equals_brute_force(spark):
    import random

    r = random.Random(4)
    left = [("v%d" % r.randint(0, 2), k, s := r.uniform(0, 100), s + r.uniform(0, 30)) for k in range(120)]
    right = [("v%d" % r.randint(0, 2), k, s := float(r.randint(0, 100)), s + r.choice([0.0, 5.0, 60.0])) for k in range(120)]
    make = lambda rows: spark.createDataFrame(rows, "video_id string, n int, start_s double, end_s double")
    got = sorted((x.a, x.b) for x in interval.overlap_join(make(left), make(right), "video_id", 7.0).select(F.col("l.n").alias("a"), F.col("r.n").alias("b")).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])


def test_nearest_join(spark):
    points = spark.createDataFrame([("v", t) for t in (0.0, 1.5, 2.0, 9.0)] + [("w", 1.0)], "video_id string, t double")
    items = spark.createDataFrame([("v", 1.0, 1), ("v", 2.0, 2), ("v", 5.0, 3)], "video_id string, t_s double, frame_no int")
    got = {(r.video_id, r.t): r.nearest and r.nearest.frame_no for r in interval.nearest_join(points, items, "video_id").collect()}
    assert got == {("v", 0.0): 1, ("v", 1.5): 1, ("v", 2.0): 2, ("v", 9.0): 3, ("w", 1.0): None}


def test_nearest_join_ties_and_nulls(spark):
    """Of frames of one time the first, before a point and after it; a point without a time has none, a frame without a time isn't one."""
    points = spark.createDataFrame([("v", t) for t in (1.0, 4.0, 5.0, 7.0, None)], "video_id string, t double")
    items = spark.createDataFrame([("v", 4.0, 20), ("v", 4.0, 10), ("v", 10.0, 30), ("v", None, 1), ("v", 10.0, 31)], "video_id string, t_s double, frame_no int")
    for width in (60.0, 1.0):
        got = {r.t: r.nearest and r.nearest.frame_no for r in interval.nearest_join(points, items, "video_id", width=width).collect()}
        assert got == {1.0: 10, 4.0: 10, 5.0: 10, 7.0: 10, None: None}


def test_nearest_join_equals_brute_force(spark):
    """Cells with and without frames, frames at borders, several keys, repeated points."""
    rng = random.Random(3)
    items = [(rng.choice("ab"), round(rng.uniform(-50, 400), 1), k) for k in range(60)]
    points = [(rng.choice("abc"), round(rng.uniform(-80, 500), 1)) for _ in range(150)] * 2
    p, i = spark.createDataFrame(points, "video_id string, t double"), spark.createDataFrame(items, "video_id string, t_s double, frame_no int")
    want = []
    for v, t in points:
        own = sorted(((abs(round(s - t, 6)), s, n) for w, s, n in items if w == v))
        want.append((v, t, own[0][2] if own else -1))
    for width in (7.0, 1000.0):
        got = sorted((r.video_id, r.t, r.nearest.frame_no if r.nearest else -1) for r in interval.nearest_join(p, i, "video_id", width=width).collect())
        assert got == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 9, 32, 33, 64, 100])
def test_thinning_of_rows(spark, n):
    rows = spark.createDataFrame([("v", k / 2, k) for k in range(n)], "video_id string, t_s double, frame_no int")
    for how in ("stride", "uniform"):
        got = [[f.frame_no for f in r.frames] for r in sample.thinned(rows, ["video_id"], ["t_s", "frame_no"], how, least=10).collect()]
        kept = list(range(n))[:: max(1, n // 32)][:32] if how == "stride" else [int(i * n / 32) for i in range(32)] if n > 32 else list(range(n))
        assert got == ([[int(i * n / 10) for i in range(10)] if n < 10 else kept] if n else [])


def test_shards_are_contiguous(spark):
    rows = spark.createDataFrame([((7 * k) % 101,) for k in range(101)], "doc_id long").repartition(5)
    got = sorted(tuple(r) for r in evaluate.shard(rows, ["doc_id"], 4, saver(spark)).collect())
    assert got == [(k, k // 26) for k in range(101)]


def test_late_events_and_stream_pairs(spark, tmp_path):
    """Append mode: a window comes once the watermark has passed it, and an event later than that is not counted."""
    from temporis.streaming import live

    path, out = tmp_path / "in", tmp_path / "out"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = lambda m: f"2024-01-01T00:{m:02d}:00"
    batches = [[(1, at(1), 1, "view", 1.0), (2, at(5), 1, "view", 2.0)], [(3, at(40), 1, "view", 4.0)], [(4, at(2), 1, "view", 8.0), (5, at(59), 1, "view", 16.0)]]
    for number, rows in enumerate(batches):
        (path / f"b{number}").mkdir(parents=True)
        (path / f"b{number}" / "x.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(path))
        done = live.windowed_counts(stream, late="10 minutes").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).format("parquet").option("path", str(out)).trigger(availableNow=True).start()
        done.awaitTermination()
    got = {str(r.start)[11:16]: (r.n, r.total) for r in spark.read.parquet(str(out)).collect()}
    assert got == {"00:00": (2, 3.0)}  # the window of 00:40 still waits: the watermark stands at 00:49


def test_image_query_takes_each_querys_topk_in_its_video(spark):
    vectors = spark.createDataFrame([(v, k, [1.0, float(k)]) for v in "ab" for k in range(6)], "video_id string, clip_no int, embedding array<float>")
    queries = spark.createDataFrame([(1, "a", [1.0, 2.0], 500.0, 2), (2, "b", [1.0, 2.0], 500.0, None), (3, "a", [0.0, 0.0], 0.0, 1), (4, "b", [1.0, 2.0], 500.0, 0)], "query_id int, video_id string, query array<float>, t double, topk int")
    got = retrieval.image_search(queries, vectors, on=["video_id"]).groupBy("query_id", "video_id").count().collect()
    assert {(r.query_id, r.video_id, r["count"]) for r in got} == {(1, "a", 3), (2, "b", 6), (4, "b", 1)}


def test_results_are_told_by_tool(spark):
    told = lambda tool: value(spark, toolcall.result_text(F.lit(tool), F.lit("x"), F.lit("y")))
    assert told("video_reader") == "The tool result of <video_reader>x</video_reader> is:\n y\n"
    assert told("video_browser") == "The tool result of <video_browser_question>x</video_browser_question> is:\n y\n"
    assert told("subtitle_extractor") == "The tool results for <subtitle_extractor>x</subtitle_extractor> are:\ny\n"


def test_shared_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from temporis.plans import saving

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x"))
    with pytest.raises(RuntimeError):
        saving.folder(far, "x")


def calls(spark, said: str, compat: str = "literal") -> list[tuple]:
    rows = toolcall.parse(spark.createDataFrame([(1, 0, said)], "conv_id long, turn long, text string"), compat)
    return [(r.tool, r.body, r.question, r.topk) for r in rows.orderBy("priority", "call_no").collect()]


_R = "video_segment_retriever_textual_query"


def test_calls(spark):
    assert calls(spark, "<thinking>x</thinking><subtitle_retriever>a;b</subtitle_retriever><topk>5</topk>") == [("subtitle_retriever", "a;b", None, 5)]
    both = f"<subtitle_retriever>a</subtitle_retriever><topk>30</topk><{_R}>c</{_R}><topk>10</topk>"
    assert [c[3] for c in calls(spark, both)] == [30, 30] and [c[3] for c in calls(spark, both, "scoped")] == [10, 30]
    assert calls(spark, f"<{_R}>c</{_R}><topk>x</topk>") == [(_R, "c", None, 5)]
    assert calls(spark, "<video_reader>1; 2;3</video_reader><video_reader_question>q</video_reader_question>") == [("video_reader", "1; 2;3", "q", None)]
    assert calls(spark, "<subtitle_extractor>0:60;90:120</subtitle_extractor>") == [("subtitle_extractor", "0:60;90:120", None, None)]
    assert calls(spark, "hello") == []


def test_texts(spark):
    assert value(spark, text.after_thinking(F.lit("<thinking>a</thinking>b</thinking>c"))) == "b"
    assert value(spark, text.answer_letter(F.lit("<answer>A</answer><answer>option (B)</answer>"))) == "B"
    assert value(spark, text.answer_letter(F.lit("<answer>none</answer>"))) == "-" and value(spark, text.answer_letter(F.lit("<answer>none</answer>"), F.lit("none"))) == "none"
    assert value(spark, text.clip_numbers(F.lit("3;1; 2;x"))) == [1, 3] and value(spark, text.whole_number(F.lit(" 7 "))) == 7


def test_image_query_excludes_both_clips_at_a_border(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(6)], "clip_no int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0], 20.0)], "query_id int, query array<float>, t double")
    got = [r.clip_no for r in retrieval.image_search(queries, vectors, 4).orderBy("rank").collect()]
    assert got == [3, 4, 5]


def test_search_modes():
    assert retrieval.modes(top_k=3) == (3, None) and retrieval.modes(threshold=0.5) == (100, 0.5) and retrieval.modes(top_k_similarity=9) == (100, None)
    for bad in ({}, {"top_k": 1, "threshold": 0.1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            retrieval.modes(**bad)


def test_ranking_properties(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)] + [(99, [0.0, 0.0, 0.0])], "clip_no int, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 2.0, 0.5])], "query_id int, query array<float>")
    top = lambda q, k: [r.clip_no for r in retrieval.search(q, rows, top_k=k).orderBy("rank").collect()]
    scaled = queries.withColumn("query", vector.scale(F.col("query"), F.lit(2.0)).cast("array<float>"))
    assert top(queries, 10)[:5] == top(queries, 5) and top(scaled, 10) == top(queries, 10) and 99 not in top(queries, 100)
    blocks = retrieval.search_blocks(queries, rows, 10, block=16).orderBy("rank").collect()
    assert [r.clip_no for r in blocks] == top(queries, 10)


def test_live_rounds(spark):
    start = spark.createDataFrame([(k, "q") for k in range(3)], "conv_id long, text string")
    tools = lambda rows: toolcall.results(toolcall.parse(rows).withColumn("result", F.lit("found")))
    log = agent.run_rounds(start, scripted_model(["<subtitle_retriever>a</subtitle_retriever>", "nonsense", "<answer>D</answer>"]), tools, saver(spark))
    got = agent.replay(log).collect()
    assert [(r.rounds, r.answer) for r in got] == [(3, "D")] * 3
    assert log.where("role = 'user' and turn = 2").first().text.startswith("found\nYou have 19 rounds remaining")
    assert log.where("role = 'user' and turn = 4").first().text == agent.INVALID
    failed = agent.run_rounds(start, lambda prompt: None, tools, saver(spark))
    assert failed.where("status = 'failed'").count() == 3
    forced = agent.run_rounds(start.limit(1), lambda prompt: "hm", tools, saver(spark), most=3)
    assert forced.where(F.col("text") == agent.FORCE).count() >= 1 and agent.replay(forced, most=3).first().answer == agent.NO_ANSWER


def test_retry():
    seen = []

    def flaky(prompt):
        seen.append(prompt)
        if len(seen) < 3:
            raise OSError("busy")
        return "ok"

    assert agent.with_retry(flaky, 3)("p") == ("ok", "ok") and agent.with_retry(lambda p: 1 / 0, 2)("p") == (None, "failed")


def test_prompt_choice_rejects_unknown(spark):
    choice = lambda d: value(spark, agent.prompt_choice(F.lit(False), F.lit(d), {"a": "one"}, "s", "p"))
    assert choice("a") == "one"
    with pytest.raises(Exception, match="no prompt for dataset"):
        choice("b")


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "text", "a b"), (1, "sound", "c"), (2, "text", None), (3, "smell", "x")], "item_id long, modality string, value string")
    done = encode_modalities(rows, {"text": HashingEncoder(8), "sound": HashingEncoder(4)})
    assert {(r.item_id, r.modality, r.status) for r in done.collect()} == {(1, "text", "ok"), (1, "sound", "ok"), (2, "text", "failed"), (3, "smell", "no encoder")}
    assert set(as_map(done).first().embeddings) == {"text", "sound"}


def test_reader_plan(spark):
    frames = spark.createDataFrame([("v", k / 2, True) for k in range(200)], "video_id string, t_s double, is_valid boolean")
    turns = spark.createDataFrame([(1, 0, "<video_reader>10:12</video_reader><video_reader_question>q</video_reader_question><video_reader>3</video_reader><video_reader_question>r</video_reader_question>")], "conv_id long, turn long, text string")
    engine = Engine(spark)
    plan = engine.reader_plan(engine.calls(turns).withColumn("video_id", F.lit("v")), frames).orderBy("call_no").collect()
    assert [len(r.frames) for r in plan] == [10, 20] and plan[0].frames[0] == 10.0 and plan[1].frames[-1] == 39.5


def test_signals(spark):
    assert value(spark, numeric.repeat_to(F.lit([1.0, 2.0]).cast("array<double>"), 5)) == [1.0, 2.0, 1.0, 2.0, 1.0]
    chunks = value(spark, numeric.three_chunks(F.lit([float(k) for k in range(20)]).cast("array<double>"), 5))
    assert [len(c) for c in chunks] == [5, 5, 5] and chunks[0][0] <= 5 <= chunks[1][0] <= 10 < chunks[2][0]
    assert value(spark, numeric.depth(F.lit([0.0, 5000.0, 20000.0]).cast("array<double>"))) == [0.001, 0.5, 1.0]
    assert tuple(value(spark, numeric.resize(F.lit(1920), F.lit(1080)))) == (748, 420)

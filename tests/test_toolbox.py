"""The tool executor on small tables, its odd cases, and the joins it rests on."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporis.operators import agent, interval, toolcall
from temporis.plans.engine import Engine
from temporis.plans.saving import drop, saver
from temporis.plans.toolbox import DESCRIBE, WATCH, Toolbox
from temporis.sources.files import Settings

ONE = "video_segment_retriever_textual_query"
IMAGE = "video_segment_retriever_image_query"


@pytest.fixture(scope="module")
def box(spark):
    def says(parts) -> str | None:
        """What a message holds, in short."""
        if "fail" in parts[-1]["value"]:
            return None
        return " ".join(p["value"] if p["type"] == "text" else "*" for p in parts[:4]) + f" ({len(parts)}) {parts[-1]['value']}"

    letters = {"red": [1.0, 0.0], "dog": [0.0, 1.0], "q": [1.0, 1.0]}
    texts = spark.createDataFrame(list(letters.items()), "text string, query array<double>")
    clips = [(v, k, [1.0, float(k)]) for v in (1, 2) for k in range(4)]
    subtitles = [(1, 0, 1.0, 2.0, "it's"), (1, 1, 1.0, 3.0, 'say "no"'), (1, 2, 70.5, 71.0, "end\nof"), (2, 0, 5.0, 6.0, "two")]
    return Toolbox(
        Engine(spark, Settings()),
        spark.createDataFrame([(1, 1, "q", None), (2, 2, "q", 4.0), (3, 9, "unknown", None)], "conv_id long, video_id long, question string, offset_s double"),
        spark.createDataFrame([(1, 30.0), (2, 0.4)], "video_id long, duration double"),
        spark.createDataFrame([(v, k / 2, k, k != 3) for v in (1, 2) for k in range(100)], "video_id long, t_s double, frame_no long, is_valid boolean"),
        spark.createDataFrame(clips, "video_id long, clip_no long, embedding array<double>"),
        spark.createDataFrame(subtitles, "video_id long, seq long, start_s double, end_s double, text string"),
        spark.createDataFrame([(v, s, [1.0, float(s)]) for v, s, *_ in subtitles], "video_id long, seq long, embedding array<double>"),
        lambda rows: rows.join(texts, "text"),
        lambda rows: rows.withColumn("video_query", F.array(F.lit(1.0), F.col("t") / 10)),
        says, saver(spark), drop, tries=1,
    )


def run(spark, box, *turns):
    rows = spark.createDataFrame([(c, 1, t) for c, t in turns], "conv_id long, turn long, text string")
    return {r.conv_id: r for r in box(rows).collect()}


def told(tool, body, found):
    return f"The tool results for <{tool}>{body}</{tool}> are:\n{found}\n"


def test_searches(spark, box):
    text = f"<{ONE}>red;dog;unheard</{ONE}><topk>2</topk><{ONE}>dog</{ONE}><{IMAGE}>20.0;x</{IMAGE}>"
    got = run(spark, box, (1, text), (3, text))[1]
    assert got.tools == [IMAGE, ONE]
    # the image query has the first topk too: three clips, less those that hold second 20 (1 and 2)
    assert got.tool_result == told(ONE, "red", "[0, 1]") + told(ONE, "dog", "[3, 2]") + told(ONE, "unheard", "[]") + told(ONE, "dog", "[3, 2, 1, 0]") + told(IMAGE, "20.0", "[3]")
    assert run(spark, box, (3, text))[3].tool_result.count("[]") == 5


def test_subtitles(spark, box):
    text = "<subtitle_retriever>dog;red</subtitle_retriever><topk>2</topk><subtitle_extractor>0:60;70:71; 1 : 1;bad;1</subtitle_extractor>"
    got = run(spark, box, (1, text), (2, text))
    one = {"begin_timestamp": 1.0, "end_timestamp": 3.0, "text": 'say "no"'}, {"begin_timestamp": 70.5, "end_timestamp": 71.0, "text": "end\nof"}
    first, later, end = ({"begin_timestamp": b, "end_timestamp": e, "subtitle": t} for b, e, t in ((1, 2, "it's"), (1, 3, 'say "no"'), (70, 71, "end\nof")))
    assert got[1].tool_result == told("subtitle_retriever", "dog;red", str(list(one))) + told("subtitle_extractor", "0:60", str([first, later])) + told("subtitle_extractor", "70:71", str([end])) + told("subtitle_extractor", " 1 : 1", str([first, later]))
    two = [{"begin_timestamp": 1.0, "end_timestamp": 2.0, "text": "two"}]  # its subtitles begin four seconds late
    assert got[2].tool_result.startswith(told("subtitle_retriever", "dog;red", str(two)) + told("subtitle_extractor", "0:60", str([{"begin_timestamp": 5, "end_timestamp": 6, "subtitle": "two"}])))


def test_frames(spark, box):
    text = "<video_reader>1:2</video_reader><video_reader_question>who</video_reader_question><video_reader>3;0</video_reader> <video_reader_question>fail</video_reader_question><video_browser_question>what</video_browser_question>"
    got = run(spark, box, (1, text), (2, "<video_browser_question>what</video_browser_question>"))
    # the frame at 1.5 can't be read: one is left, repeated to ten
    reader = f"[1.0 second] * [1.0 second] * (21) {WATCH}who{DESCRIBE.format('')}"
    browser = f"[0.0 second] * [0.5 second] * (65) {WATCH}what{DESCRIBE.format('detailed ')}"
    assert got[1].tool_result == (
        f"The tool result of <video_reader>1:2</video_reader> is:\n {reader}\nThe tool result of <video_reader>3;0</video_reader> is:\n None\n"
        f"The tool result of <video_browser_question>what</video_browser_question> is:\n {browser}\n"
    )
    assert "(21)" in got[2].tool_result  # a video under a second is widened by half a second: one frame


def test_rounds_with_tools(spark, box):
    start = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "conv_id long, text string")

    def model(prompt: str) -> str:
        return f"<{ONE}>red</{ONE}>" if "assistant" not in prompt else f"<answer>{'B' if 'are:\n[0, 1' in prompt else 'C'}</answer>"

    log = agent.run_rounds(start, model, box, saver(spark), drop=drop)
    assert {r.conv_id: (r.rounds, r.answer) for r in agent.replay(log).collect()} == {1: (2, "B"), 2: (2, "B"), 3: (2, "C")}
    assert box(start.select("conv_id", F.lit(1).alias("turn"), "text")).count() == 0


def test_quoting(spark):
    for text in ("plain", "it's", 'a "b"', "both ' and \"", "a\\b\n\t"):
        assert spark.range(1).select(toolcall.quoted(F.lit(text))).first()[0] == repr(text)


def test_intervals_of_all_lengths(spark):
    rng = np.random.default_rng(2)
    make = lambda n, seed: [(int(rng.integers(3)), k, float(b), float(b + rng.choice([0, 0.5, 3, 60, 7200, 90_000]) * rng.random())) for k, b in enumerate(rng.integers(0, 20_000, n))]
    left, right = make(150, 1), make(150, 2)
    left += [(0, 900, 5.0, 4.0), (0, 901, None, 4.0), (1, 902, -50.0, 1e6), (2, 903, 10.0, 10.0)]
    right += [(2, 904, 10.0, 10.0)]
    frame = lambda rows: spark.createDataFrame(rows, "video_id long, n long, start_s double, end_s double")
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and None not in (*a, *b) and a[2] <= a[3] and a[2] <= b[3] and b[2] <= a[3])
    got = sorted((r.a, r.b) for r in interval.overlap_join(frame(left), frame(right), "video_id", 10.0).select(F.col("l.n").alias("a"), F.col("r.n").alias("b")).collect())
    assert got == want and len(want) > 1000


def test_long_interval_is_a_few_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 7200.0), (2, 3.0, 4.0), (3, 5.0, 5.0)], "video_id long, start_s double, end_s double")
    assert interval.interval_levels(rows, 10.0) == [0, 5]
    for others in ([0], [0, 5], list(range(interval.LEVELS + 1))):
        sizes = {r["n_key"]: r["count"] for r in interval.interval_cells(rows, "n", "video_id", 10.0, others).groupBy("n_key").count().collect()}
        assert sizes[1] < 20 and sizes[2] <= 2 * (1 + len(others))
    assert {r["n_key"]: r["count"] for r in interval.interval_cells(rows, "n", "video_id", 10.0, [0]).groupBy("n_key").count().collect()} == {1: 1, 2: 1, 3: 1}

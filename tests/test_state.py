"""Conversations closed by timers, state that ends by itself, sketches, functions of one's own."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from temporis.functions import own
from temporis.functions import sketches as S
from temporis.operators import agent
from temporis.streaming import runs, stateful

TURN = "conv_id long, turn long, role string, text string, at timestamp"


def at(minutes: float) -> pd.Timestamp:
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)


def turns(spark, rows):
    return spark.createDataFrame([(c, t, role, text, at(m).to_pydatetime()) for c, t, role, text, m in rows], TURN)


def test_conversations_close_by_timer_and_late_turns_open_nothing(spark):
    tool = "<subtitle_retriever>a</subtitle_retriever>"
    first = [(1, 0, "user", "q", 0), (1, 1, "assistant", tool + tool, 1), (2, 0, "user", "q", 0), (2, 1, "assistant", "<answer>(B)</answer>", 1), (3, 0, "user", None, 29)]
    second = [(1, 3, "assistant", "<answer>none</answer>", 3), (1, 2, "user", "found", 2), (3, 1, "assistant", "hm", 31)]
    past = [(9, 0, "user", "", 65)]  # everything up to minute 55 is past
    close = [(9, 1, "user", "", 65.1)]  # timers run out in the batch after that
    late = [(1, 5, "user", "too late", 56), (9, 2, "assistant", "x", 66)]
    end = [(10, 0, "user", "", 600)]
    parts = [turns(spark, x) for x in (first, second, past, close, late, end)]
    done = runs.outcome(stateful.closed_conversations(runs.in_turn(spark, parts, "t"), gap=1200, late="10 minutes"), "closed", "append", rocks=True)
    got = {(r.conv_id, r.kind): r for r in done.collect()}
    assert {(c, k) for c, k in got} == {(1, "closed"), (2, "closed"), (3, "closed"), (9, "closed"), (1, "late")}
    assert got[1, "late"].n_messages == 1 and got[1, "closed"].tools == {"subtitle_retriever": 2} and got[3, "closed"].tools == {}
    batch = parts[0].unionByName(parts[1])
    want = {r.conv_id: (r.rounds, r.n_messages, r.answer, r.tool_turns) for r in agent.replay(batch.fillna("", ["text"])).collect()}
    assert {c: (got[c, "closed"].rounds, got[c, "closed"].n_messages, got[c, "closed"].answer, got[c, "closed"].tool_turns) for c in (1, 2, 3)} == want
    assert got[2, "closed"].answer == "B" and got[2, "closed"].at == at(21).to_pydatetime()


def test_replayed_stops_at_the_most_rounds():
    rows = [(k, "assistant" if k % 2 else "user", "hm") for k in range(60)]
    assert stateful.replayed(rows) == {"rounds": 20, "n_messages": 41, "answer": agent.NO_ANSWER, "tool_turns": 0}
    beside = [(0, "assistant", "<answer>A</answer><subtitle_retriever>x"), (1, "assistant", "<answer>C</answer>")]
    assert stateful.replayed(beside)["answer"] == "A" and stateful.replayed(beside, evaluation=True) == {"rounds": 2, "n_messages": 2, "answer": "C", "tool_turns": 1}


def test_kinds_are_told_again_after_their_time_to_live(spark, tmp_path):
    """A query of processing time never runs dry, so it is stopped once it has told what is to come."""
    kinds = "user_id long, event_type string, event_id long"
    source = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
    write([(1, "a", 3), (1, "a", 2), (1, None, 4), (2, "a", 5)])
    stream = stateful.first_of_kind(spark.readStream.schema(kinds).parquet(source), ttl=3.0)
    told: list[tuple] = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(processingTime="1 second").foreachBatch(lambda b, _: told.extend(tuple(r) for r in b.collect())).start()

    def until(n: int) -> list[tuple]:
        stop = time.time() + 60
        while len(told) < n and time.time() < stop and query.isActive:
            time.sleep(0.2)
        return sorted(told, key=repr)

    try:
        assert until(3) == [(1, "", 4), (1, "a", 2), (2, "a", 5)]
        time.sleep(4)
        write([(1, "a", 8)])  # forgotten by now
        assert (1, "a", 8) in until(4)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_sketches_merge(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    table = pd.DataFrame({"day": rng.integers(0, 30, n), "user": rng.integers(0, 20_000, n), "value": rng.normal(size=n), "kind": rng.choice(list("abcdefgh"), n, p=[0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.04, 0.01])})
    rows = spark.createDataFrame(table)
    days = S.sketched(rows, [F.col("day")], "user", "value", "kind")
    week = (F.col("day") / 7).cast("int").alias("week")
    for sketch, part in ((S.merged(days, [week]), table.groupby(table.day // 7)), (S.merged(S.merged(days, [week]), [F.lit(0).alias("week")]), table.groupby(table.day * 0))):
        told = {r.week: r for r in S.read(sketch, ["week"], [0.1, 0.5, 0.99], 3).collect()}
        assert len(told) == part.ngroups
        for key, own_rows in part:
            r = told[key]
            exact = own_rows.user.nunique()
            assert r.n == len(own_rows) and abs(r.users - exact) <= S.SIGMAS * 1.04 / 64 * exact
            assert all(abs((own_rows.value <= q).mean() - p) < S.RANK_ERROR for q, p in zip(r.quantiles, (0.1, 0.5, 0.99), strict=True))
            assert [(x["item"], x["count"]) for x in r.top] == [(k, c) for k, c in own_rows.kind.value_counts().head(3).items()]


def test_own_aggregate_keeps_null_groups_and_leaves_null_values_out(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), (None, -3.0), ("n", None)], "kind string, value double").repartition(3)
    got = {r.kind: r.mean for r in own.geometric_means(rows, "kind", "value").collect()}
    assert got == {"a": pytest.approx(2.0), None: pytest.approx(4.0), "n": None}
    assert own.geometric_means(rows.limit(0), "kind", "value").count() == 0


def test_own_scalar_and_table_functions(spark):
    texts = ["abc", "", None, "é🙂", "x" * 5000]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string")
    assert {r.conv_id: r.n for r in rows.select("conv_id", own.code_point_sum("text").alias("n")).collect()} == {k: None if t is None else sum(map(ord, t)) for k, t in enumerate(texts)}
    got = sorted((r.conv_id, r.place, r.code) for r in own.code_points(rows, "text").collect())
    assert got == [(k, i, ord(c)) for k, t in enumerate(texts) for i, c in enumerate(t or "")]

"""Live forms: windowed counts of timed events, and conversation state kept turn by turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, kind, n, total of events (ts, event_type, value), batch or stream; a stream closes windows by watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, n of sessions: events of a user less than a gap apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def followed(first: DataFrame, then: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """view_id, click_id: events of `first` with those of `then` of the same user, from its time to `within` after it. Watermarks and the
    bound on times let a stream forget what can't match any more."""
    a = first.select(F.col("event_id").alias("view_id"), F.col("user_id").alias("a_user"), F.col("ts").cast("timestamp").alias("a_ts"))
    b = then.select(F.col("event_id").alias("click_id"), F.col("user_id").alias("b_user"), F.col("ts").cast("timestamp").alias("b_ts"))
    if first.isStreaming:
        a, b = a.withWatermark("a_ts", late), b.withWatermark("b_ts", late)
    near = F.expr(f"a_user = b_user and b_ts >= a_ts and b_ts <= a_ts + interval {within}")
    return a.join(b, near).select("view_id", "click_id")


STATE = "conv_id long, rounds long, n_messages long, answer string"


def conversation_state(turns: DataFrame) -> DataFrame:
    """conv_id, rounds, n_messages, answer after each batch of turns (conv_id, turn, role, text): an update stream.

    Turns may come in any order: state holds a count, and the answer of the earliest answering turn.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import re

        rounds, n, at, answer = state.get if state.exists else (0, 0, -1, "")
        for p in batches:
            for turn, role, text in zip(p.turn, p.role, p.text, strict=True):
                n += 1
                rounds += role == "assistant"
                found = re.findall("(?s)<answer>(.*?)</answer>", text or "") if role == "assistant" else []
                if found and (at < 0 or turn < at):
                    letter = re.search("[A-Z]", found[-1])
                    at, answer = int(turn), letter[0] if letter else "-"
        state.update((int(rounds), int(n), int(at), answer))
        yield pd.DataFrame({"conv_id": [key[0]], "rounds": [rounds], "n_messages": [n], "answer": [answer or None]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, STATE, "rounds long, n long, at long, answer string", "update", "NoTimeout")


def append_live(results: DataFrame, path: str, checkpoint: str):
    """Write a stream of results as new files, once each."""
    return results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)

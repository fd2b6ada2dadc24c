"""Keyed state with timers: conversations that close when nothing more comes, and events told once within a time.

State is kept by the RocksDB store (see runs.outcome), so it may outgrow memory. A processor sees one key at a time; what it holds of a key is that
key's open conversation, or the kinds of events it has seen, and both end: by a timer of event time, or by a time to live.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from temporis.operators import agent

CLOSED = "conv_id long, kind string, rounds long, n_messages long, answer string, tool_turns long, tools map<string,long>, at timestamp"
_ROW = {"conv_id": None, "kind": None, "rounds": None, "n_messages": None, "answer": None, "tool_turns": None, "tools": None, "at": None}


def replayed(turns: list[tuple[int, str, str]], most: int = agent.MAX_ROUNDS, evaluation: bool = False) -> dict:
    """rounds, n_messages, answer, tool_turns of one conversation's turns (turn, role, text), as agent.replay has them."""
    rounds = messages = tool_turns = 0
    answer = agent.NO_ANSWER
    for _, role, text in sorted(turns):
        if role == "assistant":
            if rounds == most:
                break
            rounds += 1
            asks = any(tag in text for tag in agent.TOOL_TAGS)
            tool_turns += asks
        messages += 1
        if role == "assistant" and "<answer>" in text and not (evaluation and asks):
            last = re.findall("(?s)<answer>(.*?)</answer>", text)
            letter = re.search("[A-Z]", last[-1]) if last else None
            answer = letter[0] if letter else text
            break
    return {"rounds": rounds, "n_messages": messages, "answer": answer, "tool_turns": tool_turns}


class Conversations(StatefulProcessor):
    """Turns wait in a list, their tools are counted in a map; a timer `gap` seconds after the latest turn closes the conversation. A turn that comes after
    that, though not behind the watermark, is told as late and opens nothing."""

    def __init__(self, gap: float, evaluation: bool = False) -> None:
        self.gap, self.evaluation = gap, evaluation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, role string, text string")
        self.tools = handle.getMapState("tools", "tool string", "n long")
        self.ends = handle.getValueState("ends", "at long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, closed = self.ends.get() if self.ends.exists() else (-1, False)
        late = 0
        for p in rows:
            if closed:
                late += len(p)
                continue
            texts = p.text.fillna("")
            self.turns.appendList(list(zip(p.turn.astype(int), p.role.fillna(""), texts, strict=True)))
            for text in texts[p.role == "assistant"]:
                for tag in agent.TOOL_TAGS:
                    if n := text.count(tag):
                        held = self.tools.getValue((tag,))
                        self.tools.updateValue((tag,), ((held[0] if held else 0) + n,))
            ends, before = max(ends, int(p["at"].max().timestamp() * 1000 + self.gap * 1000)), ends
            if before >= 0 and before != ends:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        self.ends.update((ends, closed))
        if late:
            yield pd.DataFrame([_ROW | {"conv_id": key[0], "kind": "late", "n_messages": late}])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, _ = self.ends.get()
        if expiredTimerInfo.getExpiryTimeInMs() != ends:
            return
        tools = {k[0].strip("<>"): v[0] for k, v in self.tools.iterator()}
        row = replayed([tuple(t) for t in self.turns.get()], evaluation=self.evaluation)
        self.turns.clear()
        self.tools.clear()
        self.ends.update((ends, True))
        yield pd.DataFrame([_ROW | row | {"conv_id": key[0], "kind": "closed", "tools": tools, "at": pd.Timestamp(ends, unit="ms")}])

    def close(self) -> None:
        pass


def closed_conversations(turns: DataFrame, gap: float = 600.0, late: str = "10 minutes", evaluation: bool = False) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text, at) -> a row (kind closed) for each conversation once the watermark is `gap` seconds past its
    latest turn, and rows (kind late) that count turns which come after that."""
    rows = turns.select("conv_id", "turn", "role", "text", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversations(gap, evaluation), CLOSED, "append", "eventTime")


class FirstOfKind(StatefulProcessor):
    """The first event of each kind of a key; a kind that has been seen is forgotten after `ttl` seconds."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "event_id long", ttlDurationMs=int(self.ttl * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for p in rows:
            for kind, event in p.groupby("kind").event_id.min().items():
                first[kind] = min(first.get(kind, event), int(event))
        fresh = {kind: event for kind, event in first.items() if not self.seen.containsKey((kind,))}
        for kind, event in fresh.items():
            self.seen.updateValue((kind,), (event,))
        yield pd.DataFrame({"user_id": [key[0]] * len(fresh), "kind": list(fresh), "event_id": list(fresh.values())})

    def close(self) -> None:
        pass


def first_of_kind(events: DataFrame, ttl: float = 3600.0) -> DataFrame:
    """A stream of events (user_id, event_type, event_id) -> user_id, kind, event_id of the first of each kind, told again only after ttl seconds
    of processing time. Within one micro-batch the smallest event_id is the first."""
    rows = events.select("user_id", F.coalesce("event_type", F.lit("")).alias("kind"), "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(FirstOfKind(ttl), "user_id long, kind string, event_id long", "update", "processingTime")

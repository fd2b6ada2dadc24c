"""Model calls from tasks: limits in flight, deadlines, pauses, order."""

from __future__ import annotations

import asyncio
import threading
import time

import pandas as pd
import pytest

from temporis.operators import agent, calls


class Server:
    """A stub that sleeps, and knows how many calls it had at once."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.now, self.most, self.lock = seconds, 0, 0, threading.Lock()

    def __call__(self, request: str) -> str:
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(self.seconds)
        with self.lock:
            self.now -= 1
        return f"said {request}"


def run(requests, model, limit, size=1000, **more):
    batches = (pd.DataFrame({"n": range(a, min(a + size, len(requests))), "x": requests[a : a + size]}) for a in range(0, len(requests), size))
    return pd.concat(list(calls.answered(batches, "x", calls.Pool(model, limit, **more))))


@pytest.mark.parametrize("size", [1000, 7])
def test_wall_time_follows_the_limit(size):
    requests, server = [str(k) for k in range(40)], Server(0.1)
    began = time.perf_counter()
    got = run(requests, server, 10, size)
    took = time.perf_counter() - began
    assert got.text.tolist() == [f"said {k}" for k in requests] and got.n.tolist() == list(range(40))
    assert server.most == 10 and 0.4 <= took < 1.5  # forty calls of a tenth, ten at once


def test_coroutines():
    async def model(request: str) -> str:
        await asyncio.sleep(0.05)
        return request.upper()

    assert run(["a", "b", "c"], model, 2).text.tolist() == ["A", "B", "C"]


def test_deadline_frees_the_place():
    def model(request: str) -> str:
        time.sleep(1.5 if request == "slow" else 0.01)
        return "ok"

    began = time.perf_counter()
    got = run(["slow", "b", "c", "d"], model, 1, tries=1, deadline=0.2)
    assert time.perf_counter() - began < 1.2
    assert list(zip(got.text, got.status, strict=True)) == [(None, "timeout"), ("ok", "ok"), ("ok", "ok"), ("ok", "ok")]


def test_tries_and_pauses():
    seen: dict[str, list[float]] = {}

    def model(request: str) -> str:
        seen.setdefault(request, []).append(time.perf_counter())
        if request == "never" or len(seen[request]) < 3:
            raise OSError("busy")
        return "ok"

    got = run(["a", "never"], model, 2, tries=3, wait=0.1)
    assert got.status.tolist() == ["ok", "failed"] and got.tries.tolist() == [3, 3] and got.text.tolist() == ["ok", None]
    first, second, third = seen["a"]
    assert 0.07 < second - first < 0.2 and 0.14 < third - second < 0.4  # pauses double
    assert run(["x", ""], lambda r: r, 1, tries=2).status.tolist() == ["ok", "failed"]
    with pytest.raises(ValueError):
        calls.Pool(model, 0)


def test_ask_shares_out_what_may_be_in_flight(spark):
    rows = spark.range(60).selectExpr("id as conv_id", "cast(id as string) as prompt")
    spoken = calls.ask(rows, lambda r: (time.sleep(0.1), f"said {r}")[1], "prompt", in_flight=20, tasks=4)
    assert spoken.rdd.getNumPartitions() == 4 and spoken.columns == ["conv_id", "text", "status", "tries"]
    assert {(r.conv_id, r.text, r.status) for r in spoken.collect()} == {(k, f"said {k}", "ok") for k in range(60)}
    assert calls.ask(rows.limit(0), lambda r: r, "prompt").count() == 0
    got = agent.ask(rows, lambda r: time.sleep(3) if r == "7" else r, tries=1, deadline=0.5).collect()
    assert {r.conv_id: r.status for r in got} == {k: "timeout" if k == 7 else "ok" for k in range(60)}

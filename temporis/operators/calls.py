"""Calls of model plug-ins from tasks: many in flight, each with a deadline, tried again with growing pauses, in order.

A task keeps a limited number of calls in flight, across the batches that it reads, so a slow answer holds up neither the others nor the
next batch. A plug-in is a function or a coroutine function of one request. Functions run in threads of their own: one that overruns its
deadline is given up, its place is free at once, and what it returns later is dropped.
"""

from __future__ import annotations

import asyncio
import inspect
import random
import threading
from collections import deque
from collections.abc import Awaitable, Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[Any], Any]
#: Calls in flight over all tasks, and seconds that a language model may take.
IN_FLIGHT, DEADLINE = 200, 1800.0


def _in_thread(model: Model, request: Any) -> Awaitable[Any]:
    loop = asyncio.get_running_loop()
    done = loop.create_future()

    def put(setter: Callable, value: Any) -> None:
        if not done.done():
            setter(value)

    def run() -> None:
        try:
            how, value = done.set_result, model(request)
        except Exception as e:  # a plug-in may raise anything; it counts as a try that failed
            how, value = done.set_exception, e
        if not loop.is_closed():
            loop.call_soon_threadsafe(put, how, value)

    threading.Thread(target=run, daemon=True).start()
    return done


class Pool:
    """Calls of one task: at most `limit` in flight, `tries` each, `deadline` seconds a try, pauses of `wait` seconds that double."""

    def __init__(self, model: Model, limit: int, tries: int = 3, wait: float = 0.0, deadline: float = DEADLINE) -> None:
        if limit < 1 or tries < 1:
            raise ValueError("limit and tries must be at least 1")
        self.model, self.tries, self.wait, self.deadline = model, tries, wait, deadline
        self.limit, self.slots = limit, asyncio.Semaphore(limit)
        self.is_async = inspect.iscoroutinefunction(model)

    async def call(self, request: Any) -> tuple[str | None, str, int]:
        """Text, status and tries made: ok, failed (no text), timeout (the last try overran)."""
        status = "failed"
        for n in range(self.tries):
            if n and self.wait:  # outside the slots: a pause holds up nobody
                await asyncio.sleep(self.wait * 2 ** (n - 1) * random.Random(f"{request}{n}").uniform(0.75, 1.25))
            try:
                async with self.slots:
                    out = await asyncio.wait_for(self.model(request) if self.is_async else _in_thread(self.model, request), self.deadline)
                if out:
                    return str(out), "ok", n + 1
                status = "failed"
            except TimeoutError:
                status = "timeout"
            except Exception:  # as above
                status = "failed"
        return None, status, self.tries


def answered(batches: Iterator[pd.DataFrame], column: str, pool: Pool) -> Iterator[pd.DataFrame]:
    """Batches with text, status and tries in place of column, in order. Calls of later batches begin while earlier ones still run, as long as no more
    than twice the limit are under way or waiting."""
    loop = asyncio.new_event_loop()
    under_way: deque[tuple[pd.DataFrame, list[asyncio.Task]]] = deque()

    def finish() -> pd.DataFrame:
        rows, calls = under_way.popleft()
        got = loop.run_until_complete(asyncio.wait_for(_all(calls), None)) if calls else []
        return rows.drop(columns=[column]).assign(**{name: [g[k] for g in got] for k, name in enumerate(("text", "status", "tries"))})

    try:
        for p in batches:
            under_way.append((p, [loop.create_task(pool.call(x)) for x in p[column]]))
            loop.run_until_complete(asyncio.sleep(0))  # new calls set out
            while sum(not c.done() for _, calls in under_way for c in calls) > 2 * pool.limit:
                yield finish()
        while under_way:
            yield finish()
    finally:
        loop.close()


async def _all(calls: list[asyncio.Task]) -> list:
    return await asyncio.gather(*calls)


def ask(requests: DataFrame, model: Model, column: str, in_flight: int = IN_FLIGHT, tasks: int | None = None, tries: int = 3, wait: float = 0.0, deadline: float = DEADLINE) -> DataFrame:
    """requests with text, status and tries in place of column. in_flight is shared out over `tasks` tasks (as many as the session has cores, where not given),
    so that a model server never sees more, whatever the number of rows."""
    n = min(in_flight, tasks or requests.sparkSession.sparkContext.defaultParallelism)
    kinds = [(c, t) for c, t in requests.dtypes if c != column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from answered(batches, column, Pool(model, in_flight // n, tries, wait, deadline))

    return requests.repartition(n).mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in kinds), "text string, status string, tries int"]))

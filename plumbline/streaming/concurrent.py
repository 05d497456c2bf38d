"""Pipelines and reviewers that wait on other services, several attempts at once in each task, with results in order.

A task has one event loop and at most `in_flight` attempts under way. Rows are taken from the input as places fall free, and results leave in
the order of the input; at most `backlog` rows are held for that, whatever a slow one keeps waiting. When something other than an attempt's own
failure goes wrong, what is under way is cancelled and awaited, and nothing more is started.
"""

from __future__ import annotations

import asyncio
import copy
from collections import deque
from collections.abc import Awaitable, Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["case_id", "repeat", "context", "answer", "review_correct", "error_phase", "error_type"]
DDL = "case_id string, repeat int, context array<string>, answer string, review_correct boolean, error_phase string, error_type string"


def in_order(rows: Iterable, start: Callable[[object], Awaitable], in_flight: int, backlog: int) -> Iterator:
    """The results of start(row) in the order of rows, with at most in_flight of them awaited at a time."""
    if in_flight < 1 or backlog < in_flight:
        raise ValueError("one attempt at least is under way, and as many are held")
    loop, rows, held, active = asyncio.new_event_loop(), iter(rows), deque(), set()
    more = True
    try:
        while more or held:
            while more and len(active) < in_flight and len(held) < backlog:
                row = next(rows, rows)
                if row is rows:
                    more = False
                else:
                    task = loop.create_task(start(row))
                    active.add(task)
                    held.append(task)
            if active:
                done, active = loop.run_until_complete(asyncio.wait(active, return_when=asyncio.FIRST_COMPLETED))
                for task in done:
                    task.result()  # a failure ends all, even if rows before it are still under way
            while held and held[0].done():
                yield held.popleft().result()
    finally:
        for task in active:
            task.cancel()
        if active:
            loop.run_until_complete(asyncio.gather(*active, return_exceptions=True))
        loop.close()


def _checked(out: object) -> dict:
    if not isinstance(out, dict) or not isinstance(out.get("answer"), str | None) or not all(isinstance(c, str) for c in out.get("context") or ()):
        raise TypeError("a pipeline gives context (texts) and answer (a text)")
    return out


async def attempt(case: str, repeat: int, query: str, pipeline: Callable, review: Callable | None, on_attempt: Callable | None) -> tuple:
    """One row: an attempt's outputs, and its failure by phase (pipeline, output, review) and the name of its class."""
    out, verdict, phase, kind = {}, {}, "pipeline", None
    try:
        made = await pipeline(query)
        phase = "output"
        out = _checked(made)
        phase = "review"
        verdict = await review(query, copy.deepcopy(out)) if review else {}
        phase = None
    except Exception as e:  # noqa: BLE001  the error is data
        kind = type(e).__name__[:128]
    row = case, int(repeat), out.get("context"), out.get("answer"), verdict.get("correct"), phase, kind
    if on_attempt:
        await on_attempt(dict(zip(COLUMNS, copy.deepcopy(row), strict=True)))
    return row


def evaluate_concurrently(
    cases: DataFrame, pipeline: Callable, review: Callable | None, repeats: int, in_flight: int = 8, tasks: int | None = None, backlog: int = 256, on_attempt: Callable | None = None
) -> DataFrame:
    """case_id, repeat, context, answer, review_correct, error_phase, error_type: one row for every planned attempt, as evaluate_rag gives them.

    pipeline(query), review(query, output) and on_attempt(attempt) are coroutines. on_attempt is awaited when an attempt is whole, has a copy of
    it, and fails the job if it fails. in_flight bounds the attempts under way in each of `tasks` tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(b["case_id"], b["repeat"], b["query"], strict=True))
        some = []
        for result in in_order(rows, lambda r: attempt(*r, pipeline, review, on_attempt), in_flight, max(backlog, in_flight)):
            some.append(result)
            if len(some) == 256:
                yield pd.DataFrame(some, columns=COLUMNS)
                some = []
        yield pd.DataFrame(some, columns=COLUMNS)

    planned = cases.select("case_id", "query", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    dealt = planned if tasks is None else planned.repartition(tasks, "case_id")
    return dealt.sortWithinPartitions("case_id", "repeat").mapInPandas(run, DDL)

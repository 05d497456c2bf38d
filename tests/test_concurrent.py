"""Attempts at once: bounded, in order, failures as data, hooks, and an end without loose ends."""

from __future__ import annotations

import asyncio

import pytest

from plumbline.streaming.concurrent import evaluate_concurrently, in_order


def test_bounded_and_in_order():
    now, most, finished, started = 0, 0, [], []

    async def work(i):
        nonlocal now, most
        started.append(i)
        now += 1
        most = max(most, now)
        await asyncio.sleep(0.05 if i % 10 == 0 else 0.001)
        now -= 1
        finished.append(i)
        return i

    out = []
    for r in in_order(range(50), work, 4, 8):
        assert max(started) - r < 8 + 1  # no more are held than the backlog
        out.append(r)
    assert out == list(range(50)) and most == 4 and finished != out


def test_rows_are_taken_as_places_fall_free():
    taken = []

    def rows():
        for i in range(1000):
            taken.append(i)
            yield i

    async def work(i):
        return i

    it = in_order(rows(), work, 3, 5)
    assert next(it) == 0 and len(taken) <= 8
    it.close()


def test_a_failure_cancels_what_is_under_way():
    ended, started = [], []

    async def work(i):
        started.append(i)
        try:
            if i == 2:
                await asyncio.sleep(0.01)
                raise KeyError("hook")
            await asyncio.sleep(30)
        finally:
            ended.append(i)

    with pytest.raises(KeyError):
        list(in_order(range(100), work, 3, 10))
    assert sorted(ended) == sorted(started) == [0, 1, 2]
    with pytest.raises(ValueError):
        list(in_order([], work, 0, 1))
    assert list(in_order([], work, 1, 1)) == []


def test_failures_by_phase_and_hooks(spark, tmp_path):
    async def pipeline(query):
        await asyncio.sleep(0.001 * (len(query) % 3))
        if query == "down":
            raise TimeoutError(query)
        return {"context": [query], "answer": 5 if query == "odd" else query.upper()}

    async def review(query, output):
        output["answer"] = "changed by the reviewer"
        if query == "strict":
            raise ValueError(query)
        return {"correct": query == "good"}

    place = str(tmp_path)

    async def keep(a):
        with open(f"{place}/{a['case_id']}-{a['repeat']}", "x") as f:
            f.write(str(a["error_phase"]))
        a["answer"] = "changed by the hook"

    cases = spark.createDataFrame([(q, q) for q in ("good", "bad", "down", "odd", "strict")], "case_id string, query string")
    got = {(r.case_id, r.repeat): tuple(r)[2:] for r in evaluate_concurrently(cases, pipeline, review, 2, 3, tasks=2, on_attempt=keep).collect()}
    for repeat in (0, 1):
        assert got["good", repeat] == (["good"], "GOOD", True, None, None)
        assert got["bad", repeat] == (["bad"], "BAD", False, None, None)
        assert got["down", repeat] == (None, None, None, "pipeline", "TimeoutError")
        assert got["odd", repeat] == (None, None, None, "output", "TypeError")
        assert got["strict", repeat] == (["strict"], "STRICT", None, "review", "ValueError")
    assert len(list(tmp_path.iterdir())) == 10

    async def broken(a):
        raise OSError("the disk is full")

    with pytest.raises(Exception, match="the disk is full"):
        evaluate_concurrently(cases, pipeline, None, 1, on_attempt=broken).collect()

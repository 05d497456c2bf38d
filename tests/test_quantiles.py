"""Exact quantiles, tests and resamples at any group size, against plain Python."""

from __future__ import annotations

import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import compare
from plumbline.operators.quantiles import quantiles
from plumbline.queries import QUERIES

PROBS = {"low": 0.0, "q": 0.025, "median": 0.5, "p95": 0.95, "high": 1.0}


@pytest.mark.parametrize("block_rows", [1_000_000, 97])
def test_against_numpy(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [("hot", 1, rng.gauss(0, 1)) for _ in range(700)] + [("tied", 2, float(rng.randrange(3))) for _ in range(300)] + [("one", None, 7.5), (None, 3, -1e300), (None, 3, 1e300), ("none", 4, None)]
    rows += [(f"g{i}", 5, rng.random()) for i in range(30) for _ in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(5)
    got = {(r["a"], r["b"]): r for r in quantiles(df, ["a", "b"], "x", PROBS, {"p95": 20}, block_rows).collect()}
    want = {}
    for a, b, x in rows:
        if x is not None:
            want.setdefault((a, b), []).append(x)
    assert set(got) == set(want)
    for key, xs in want.items():
        for name, p in PROBS.items():
            if name == "p95" and len(xs) < 20:
                assert got[key][name] is None
            else:
                assert got[key][name] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-12)


def test_nan_is_the_largest_and_empty_tables(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, 2.0)], "k int, x double")
    r = quantiles(df, ["k"], "x", {"m": 0.5, "h": 1.0}, block_rows=1).first()
    assert r["m"] == 2.0 and math.isnan(r["h"])
    assert quantiles(df.where("k > 5"), ["k"], "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("name", ["latency_distribution", "warm_vs_first_timing", "perf_speedups", "perf_compare_geomean"])
def test_no_percentile_over_a_group(spark, data, name):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, data).explain("formatted")
    assert "percentile(" not in out.getvalue()


def test_mcnemar_of_a_million(spark):
    pairs = [(0, 0), (3, 3), (0, 1), (1, 0), (5, 17), (40, 20), (400, 371), (20_000, 20_005), (5_000, 4_700), (499_000, 501_000)]
    begin = time.perf_counter()
    rows = spark.createDataFrame(pairs, "f long, r long").select("f", "r", stats.mcnemar(F.col("f"), F.col("r")).alias("p")).collect()
    assert time.perf_counter() - begin < 20
    for r in rows:
        if r.f + r.r < 2_000:  # whole numbers of any size take long beyond
            assert r.p == pytest.approx(stats.mcnemar_exact(r.f, r.r), rel=1e-9, abs=1e-300)
    for r in rows[-3:]:
        n, d = r.f + r.r, abs(r.f - r.r)
        assert r.p == pytest.approx(math.erfc((d - 1) / math.sqrt(n) / math.sqrt(2)), rel=2e-3)


def test_draws_are_those_of_the_twister(spark):
    for n in (1, 2, 5, 100, 1000):
        rng = random.Random(3)
        want = [[rng.randrange(n) for _ in range(n)] for _ in range(7)]
        got = {(r["resample"], r["place"]): r["times"] for r in compare.resamples_of(spark, n, 7, 3, block=2).collect()}
        assert got == {(i, p): w.count(p) for i, w in enumerate(want) for p in set(w)}


def test_bootstrap_against_plain_python(spark):
    rng = random.Random(1)
    trials = [(s, f"p{p}", f"c{c}", rng.uniform(1, 2) * (1 if s == "candidate" else 1.3)) for s in ("baseline", "candidate") for p in range(6) for c in range(3) for _ in range(4)]
    r = compare.bootstrap_speedup(spark.createDataFrame(trials, "system string, run_id string, case_id string, seconds double"), resamples=60, seed=9).first()
    medians, gs = {}, []
    for s, p, c, x in trials:
        medians.setdefault((s, c, p), []).append(x)
    medians = {k: statistics.median(v) for k, v in medians.items()}
    draws = {s: (lambda g: [[f"p{g.randrange(6)}" for _ in range(6)] for _ in range(60)])(random.Random(9 + k)) for k, s in enumerate(("baseline", "candidate"))}
    for i in range(60):
        ratios = [statistics.median(medians["baseline", f"c{c}", p] for p in draws["baseline"][i]) / statistics.median(medians["candidate", f"c{c}", p] for p in draws["candidate"][i]) for c in range(3)]
        gs.append(math.exp(sum(map(math.log, ratios)) / 3))
    assert (r.low, r.high) == (pytest.approx(float(np.quantile(gs, 0.025))), pytest.approx(float(np.quantile(gs, 0.975))))
    assert r.resamples == 60

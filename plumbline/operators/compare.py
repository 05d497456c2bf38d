"""Comparison of systems: paired outcomes, tests, deltas, drift, gates, speed-ups."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import geometric_mean, mcnemar, ratio, wilson
from ..functions.vectors import cosine, max_abs_difference, norm, scaled_rms_difference
from ..shared import saved
from .quantiles import quantiles

MAX_PROCESSES = 10_000
OUTCOMES = ["both_correct", "fixed", "regressed", "both_wrong"]


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """id, gold, before, after, outcome; both: id, gold, choice. A missing choice is wrong."""
    both = baseline.select("id", "gold", F.col("choice").alias("before")).join(candidate.select("id", F.col("choice").alias("after")), "id")
    a, b = (F.coalesce(F.col(c) == F.col("gold"), F.lit(False)) for c in ("before", "after"))
    outcome = F.when(a & b, OUTCOMES[0]).when(~a & b, OUTCOMES[1]).when(a & ~b, OUTCOMES[2]).otherwise(OUTCOMES[3])
    return both.withColumn("outcome", outcome)


def outcome_counts(pairs: DataFrame) -> DataFrame:
    """outcome, n; outcomes that don't occur have 0."""
    every = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, OUTCOMES))).alias("outcome"))
    return every.join(pairs.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def first_cases(pairs: DataFrame, most: int = 10) -> DataFrame:
    w = Window.partitionBy("outcome").orderBy("id")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def accuracy_interval(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: correct, total, accuracy and its 95 % interval."""
    out = rows.groupBy(*by).agg(F.count_if(F.coalesce(F.col("choice") == F.col("gold"), F.lit(False))).alias("correct"), F.count("*").alias("total"))
    low, high = wilson(F.col("correct"), F.col("total"))
    return out.select(*by, "correct", "total", ratio(F.col("correct"), F.col("total")).alias("accuracy"), low.alias("low"), high.alias("high"))


def test_pairs(pairs: DataFrame) -> DataFrame:
    """fixed, regressed, p_value."""
    one = pairs.agg(F.count_if(F.col("outcome") == "fixed").alias("fixed"), F.count_if(F.col("outcome") == "regressed").alias("regressed"))
    return one.withColumn("p_value", mcnemar(F.col("fixed"), F.col("regressed")))


def benchmark(runs: DataFrame) -> DataFrame:
    """Every run against the first; runs: run_ord, run, id, gold, choice.

    run, accuracy, delta, fixed, regressed, p_value, p_bonferroni (over the eligible pairs), eligible: both
    complete, over the same examples. All runs are compared in one join with the first.
    """
    least = runs.agg(F.min("run_ord").alias("b"))
    base = runs.join(F.broadcast(least), F.col("run_ord") == F.col("b")).select("id", F.col("gold").alias("base_gold"), F.col("choice").alias("base"), F.lit(True).alias("in_base"))
    both = runs.join(base, "id", "left")
    a, b = F.coalesce(F.col("base") == F.col("gold"), F.lit(False)), F.coalesce(F.col("choice") == F.col("gold"), F.lit(False))
    n = base.agg(F.count("*").alias("base_n"), F.avg((F.coalesce(F.col("base") == F.col("base_gold"), F.lit(False))).cast("double")).alias("base_accuracy"), F.count_if(F.col("base").isNull()).alias("base_missing"))
    per = both.groupBy("run_ord", "run").agg(
        F.avg(b.cast("double")).alias("accuracy"),
        F.count_if(~a & b).alias("fixed"),
        F.count_if(a & ~b).alias("regressed"),
        F.count_if(F.col("choice").isNull()).alias("missing"),
        F.count("in_base").alias("common"),
        F.count("*").alias("n"),
    )
    return _deltas(per.crossJoin(F.broadcast(n)))


def benchmark_beside(rows: DataFrame, systems: list[str]) -> DataFrame:
    """The same for systems whose choices are columns of one row an example, the first of them the baseline: one pass, no join."""
    said = F.array(*[F.struct(F.lit(i).alias("run_ord"), F.lit(name).alias("run"), F.col(name).alias("choice")) for i, name in enumerate(systems)])
    each = rows.select("gold", F.col(systems[0]).alias("base"), F.inline(said))
    a, b = F.coalesce(F.col("base") == F.col("gold"), F.lit(False)), F.coalesce(F.col("choice") == F.col("gold"), F.lit(False))
    every = F.count("*")
    per = each.groupBy("run_ord", "run").agg(
        F.avg(b.cast("double")).alias("accuracy"),
        F.count_if(~a & b).alias("fixed"),
        F.count_if(a & ~b).alias("regressed"),
        F.count_if(F.col("choice").isNull()).alias("missing"),
        every.alias("common"),
        every.alias("n"),
        every.alias("base_n"),
        F.avg(a.cast("double")).alias("base_accuracy"),
        F.count_if(F.col("base").isNull()).alias("base_missing"),
    )
    return _deltas(per)


def _deltas(per: DataFrame) -> DataFrame:
    """A row a system, so its windows are over a handful of rows."""
    first = F.col("run_ord") == F.min("run_ord").over(Window.partitionBy(F.lit(1)))
    ok = ~first & (F.col("missing") == 0) & (F.col("base_missing") == 0) & (F.col("common") == F.col("n")) & (F.col("n") == F.col("base_n"))
    per = per.withColumn("eligible", ok).withColumn("p_value", F.when(ok, mcnemar(F.col("fixed"), F.col("regressed"))))
    tests = F.count_if("eligible").over(Window.partitionBy(F.lit(1)))
    return per.select(
        "run", "accuracy", (F.col("accuracy") - F.col("base_accuracy")).alias("delta"), "fixed", "regressed", "eligible", "p_value", F.when(ok, F.least(F.lit(1.0), F.col("p_value") * tests)).alias("p_bonferroni")
    )


def vector_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """id and how far the vectors are apart; both: id, vector (doubles)."""
    both = reference.select("id", F.col("vector").alias("a")).join(candidate.select("id", F.col("vector").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    return both.select(
        "id", max_abs_difference(a, b).alias("max_abs"), scaled_rms_difference(a, b).alias("rms"), cosine(a, b).alias("cosine"), norm(a).alias("norm_reference"), norm(b).alias("norm_candidate")
    )


def margins(scores: DataFrame) -> DataFrame:
    """id, top, margin (first less second), gold_rank, gold_margin (gold less the best other); scores: id, gold, ord, cand, score."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    is_gold = F.col("cand") == F.col("gold")
    top, second = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (1, 2))
    return ranked.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cand"))).alias("top"),
        (top - second).alias("margin"),
        F.max(F.when(is_gold, F.col("rank"))).alias("gold_rank"),
        (F.max(F.when(is_gold, F.col("score"))) - F.max(F.when(~is_gold, F.col("score")))).alias("gold_margin"),
    )


def snapshot_gates(scores: DataFrame, tolerance: float) -> DataFrame:
    """Whether two snapshots agree: changed choices, largest error, passed; scores: id, ord, cand, before, after."""
    tops = [F.max(F.struct(c, (-F.col("ord")).alias("o"), "cand"))["cand"].alias(f"{c}_choice") for c in ("before", "after")]
    per = scores.groupBy("id").agg(*tops, F.max(F.abs(F.col("before") - F.col("after"))).alias("error"))
    changed = F.count_if(F.col("before_choice") != F.col("after_choice"))
    return per.agg(F.count("*").alias("cases"), changed.alias("changed_choices"), F.max("error").alias("max_score_error"), ((changed == 0) & (F.max("error") <= tolerance)).alias("passed"))


def process_medians(trials: DataFrame) -> DataFrame:
    """system, case_id, run_id, m; trials: system, run_id, case_id, seconds."""
    return quantiles(trials, ["system", "case_id", "run_id"], "seconds", {"m": 0.5})


def speedups(trials: DataFrame) -> DataFrame:
    """case_id, speedup: median over processes of their medians, baseline over candidate; trials: system, run_id, case_id, seconds."""
    per_case = quantiles(process_medians(trials), ["system", "case_id"], "m", {"m": 0.5})
    return per_case.groupBy("case_id").agg((F.max(F.when(F.col("system") == "baseline", F.col("m"))) / F.max(F.when(F.col("system") == "candidate", F.col("m")))).alias("speedup"))


def speed_report(per_case: DataFrame) -> DataFrame:
    """cases, geometric mean and the largest regression (1 / the smallest speed-up)."""
    return per_case.where("speedup is not null").agg(F.count("*").alias("cases"), geometric_mean(F.col("speedup")).alias("geomean_speedup"), (1 / F.min("speedup")).alias("max_case_regression"))


def _draws(state: tuple, n: int, count: int) -> tuple[np.ndarray, tuple]:
    """`count` whole numbers below n as random.Random draws them from a state of its twister, and the state behind them."""
    twister = np.random.RandomState()
    twister.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    bits, out, found = n.bit_length(), [], 0
    while found < count:
        # numbers of n or more are drawn again, so the last piece is redone to its very last number
        before = twister.get_state()
        raw = twister.randint(0, 1 << 32, size=max(64, int(1.1 * (count - found))), dtype=np.uint32) >> np.uint32(32 - bits)
        places = np.flatnonzero(raw < n)
        if len(places) > count - found:
            places = places[: count - found]
        if found + len(places) == count:
            twister.set_state(before)
            twister.randint(0, 1 << 32, size=int(places[-1]) + 1, dtype=np.uint32)
        out.append(raw[places].astype(np.int64))
        found += len(places)
    _, key, pos, *_ = twister.get_state()
    return np.concatenate(out), (*key.tolist(), pos)


def resamples_of(spark, n: int, resamples: int, seed: int, block: int = 50) -> DataFrame:
    """resample, place, times: how often each of n processes is drawn in each whole-process resample.

    The draws are those of random.Random(seed).randrange(n), n for each resample. The driver only runs the twister ahead and keeps its state
    at each block of resamples; the draws are made again in tasks, and only their counts leave these.
    """
    states, state = [], random.Random(seed).getstate()[1]
    for first in range(0, resamples, block):
        states.append((first, min(block, resamples - first), list(state)))
        state = _draws(state, n, n * states[-1][1])[1]

    def made(batches):
        for batch in batches:
            for first, count, state in zip(batch["first"].to_pylist(), batch["count"].to_pylist(), batch["state"].to_pylist(), strict=True):
                drawn = _draws(tuple(state), n, n * count)[0].reshape(count, n)
                for r in range(count):
                    place, times = np.unique(drawn[r], return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(place), first + r)), pa.array(place), pa.array(times)], names=["resample", "place", "times"])

    blocks = spark.createDataFrame(states, "first int, count int, state array<long>").repartition(min(len(states), 64), "first")
    return blocks.mapInArrow(made, "resample long, place long, times long")


def bootstrap_speedup(trials: DataFrame, resamples: int = 2000, seed: int = 20260924) -> DataFrame:
    """low, high: the 2.5th and 97.5th percentile of the geometric mean speed-up over resampled processes.

    Resamples are counts by process, made in tasks, and medians are weighted by them. A system has at most MAX_PROCESSES
    processes (more are an error), which bounds a resample's group.
    """
    spark = trials.sparkSession
    per_run = saved(process_medians(trials), "medians")
    parts = []
    for k, system in enumerate(("baseline", "candidate")):
        mine = per_run.where(F.col("system") == system)
        runs = mine.select("run_id").distinct()
        n = runs.limit(MAX_PROCESSES + 1).count()
        if n > MAX_PROCESSES:
            raise ValueError(f"{system} has more than {MAX_PROCESSES} processes")
        numbered = runs.withColumn("place", F.row_number().over(Window.orderBy("run_id")) - 1)  # MAX_PROCESSES rows at most
        drawn = resamples_of(spark, max(n, 1), resamples, seed + k).join(F.broadcast(numbered), "place")
        parts.append(drawn.join(mine, "run_id").groupBy("resample", "case_id").agg(F.percentile("m", F.lit(0.5), F.col("times")).alias(system)))
    per = parts[0].join(parts[1], ["resample", "case_id"]).groupBy("resample").agg(geometric_mean(F.col("baseline") / F.col("candidate")).alias("g"))
    return per.agg(F.percentile("g", F.lit(0.025)).alias("low"), F.percentile("g", F.lit(0.975)).alias("high"), F.count("*").alias("resamples"))


def seeded_order(spark, ids: list, seed: int) -> DataFrame:
    """An execution order: a seeded Mersenne shuffle of a bounded list."""
    order = list(range(len(ids)))
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(ids[i], n) for n, i in enumerate(order)], "id long, exec_ord int")


def result_drift(reference: DataFrame, actual: DataFrame) -> DataFrame:
    """Changed choices and largest score error; both: id, ord, cand, score."""
    both = reference.withColumnRenamed("score", "before").join(actual.select("id", "cand", F.col("score").alias("after")), ["id", "cand"])
    return snapshot_gates(both, 0.0).select("cases", "changed_choices", "max_score_error")

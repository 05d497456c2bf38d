"""Latency and run summaries over recorded attempts: one row per call, with a group, a repeat and seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import p95, ratio
from .quantiles import on_keys, quantiles


def distribution(x: Column) -> list[Column]:
    """Aggregates: calls, mean, median, p95 (null below 20 calls), min and max; nulls for an empty group.

    A group's values meet in one task; `latencies` is for groups of any size.
    """
    return [
        F.count(x).alias("calls"),
        F.avg(x).alias("mean_seconds"),
        F.percentile(x, F.lit(0.5)).alias("median_seconds"),
        p95(x).alias("p95_seconds"),
        F.min(x).alias("min_seconds"),
        F.max(x).alias("max_seconds"),
    ]


def latencies(calls: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, calls, mean, median, p95 (null below 20 calls), min and max of x; nulls for a group without values."""
    per = calls.groupBy(*keys).agg(F.count(x).alias("calls"), F.avg(x).alias("mean_seconds"), F.min(x).alias("min_seconds"), F.max(x).alias("max_seconds"))
    exact = quantiles(calls, keys, x, {"median_seconds": 0.5, "p95_seconds": 0.95}, {"p95_seconds": 20})
    return on_keys(per, exact, keys).select(*keys, "calls", "mean_seconds", "median_seconds", "p95_seconds", "min_seconds", "max_seconds")


def variation(x: Column) -> Column:
    """Coefficient of variation, with the population's standard deviation."""
    return ratio(F.stddev_pop(x), F.avg(x))


def first_and_warm(calls: DataFrame, group: str) -> DataFrame:
    """The first call apart from the median, minimum and maximum of the others; calls: group, repeat, seconds."""
    first, warm = F.col("repeat") == 0, F.when(F.col("repeat") > 0, F.col("seconds"))
    per = calls.groupBy(group).agg(
        F.max(F.when(first, F.col("seconds"))).alias("first_seconds"),
        F.min(warm).alias("warm_min_seconds"),
        F.max(warm).alias("warm_max_seconds"),
    )
    exact = quantiles(calls.where("repeat > 0"), [group], "seconds", {"warm_median_seconds": 0.5})
    return on_keys(per, exact, [group]).select(group, "first_seconds", "warm_median_seconds", "warm_min_seconds", "warm_max_seconds")


def run_summary(calls: DataFrame, planned: int | None = None) -> DataFrame:
    """One row; calls: example, repeat, choice (null: failed), seconds.

    An example is unstable if its successful calls chose differently.
    """
    per = calls.groupBy("example").agg(
        F.size(F.collect_set("choice")).alias("choices"),
        F.max(F.when(F.col("repeat") == 0, F.col("choice"))).alias("first_choice"),
        F.count("*").alias("n"),
        F.count("choice").alias("ok"),
        F.sum("seconds").alias("spent"),
    )
    return per.agg(
        F.count("*").alias("attempted_examples"),
        F.sum(F.col("n") - F.col("ok")).alias("failed_calls"),
        F.count_if(F.col("choices") > 1).alias("unstable_examples"),
        F.count_if(F.col("first_choice").isNull()).alias("failed_first_attempts"),
        ratio(F.sum("ok"), F.sum("spent")).alias("successful_calls_per_second"),
    )


def drift_from_first(scores: DataFrame) -> DataFrame:
    """Largest change of a score against the first successful call; scores: example, candidate, repeat, score (null: failed)."""
    w = Window.partitionBy("example", "candidate").orderBy("repeat").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("score", ignorenulls=True).over(w)
    return scores.withColumn("drift", F.abs(F.col("score") - first)).groupBy("example").agg(F.coalesce(F.max("drift"), F.lit(0.0)).alias("max_score_drift"))


def fixed_denominator(calls: DataFrame, repeats: int | None = None) -> DataFrame:
    """Quality against the planned number of calls, and throughput; calls: example, repeat, correct, tokens, seconds.

    Without a number, as many calls are planned as the example with the most has, and none is left out.
    """
    if repeats is None:
        planned = calls.agg((F.max("repeat") + 1).alias("planned"))
        some = calls.crossJoin(F.broadcast(planned))  # one row
    else:
        some = calls.where(F.col("repeat") < repeats).withColumn("planned", F.lit(repeats))
    return some.groupBy("example").agg(
        (F.count_if("correct") / F.first("planned").cast("double")).alias("quality"),
        ratio(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"),
        ratio(F.count("*"), F.sum("seconds")).alias("requests_per_second"),
    )


def high_water(samples: DataFrame, key: str, value: str) -> DataFrame:
    return samples.groupBy(key).agg(F.max(value).alias("high_water"))

"""Routing with a reject label: counts, rates that stay unknown when failures could hide harm, tie-aware curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from .running import running


def counts(predictions: DataFrame, reject: str) -> DataFrame:
    """Nine counts in one row; predictions: gold, choice. A missing choice is no rejection."""
    out = F.col("gold") == reject
    missing, rejected, right = F.col("choice").isNull(), F.col("choice") == reject, F.col("choice") == F.col("gold")
    rejected, right = (F.coalesce(c, F.lit(False)) for c in (rejected, right))
    return predictions.agg(
        F.count_if(~out).alias("in_scope"),
        F.count_if(out).alias("out_of_scope"),
        F.count_if(~out & right).alias("correct_routes"),
        F.count_if(~out & ~missing & ~rejected & ~right).alias("wrong_routes"),
        F.count_if(~out & rejected).alias("false_rejections"),
        F.count_if(out & rejected).alias("correct_rejections"),
        F.count_if(out & ~missing & ~rejected).alias("false_accepts"),
        F.count_if(~out & missing).alias("in_scope_failures"),
        F.count_if(out & missing).alias("out_of_scope_failures"),
    )


def rates(c: DataFrame) -> DataFrame:
    """rate, value, numerator, denominator, low, high, reason of the counts."""
    ins, oos, tp, fp = (F.col(x) for x in ("in_scope", "out_of_scope", "correct_rejections", "false_rejections"))
    routed = F.col("correct_routes") + F.col("wrong_routes") + F.col("false_accepts")
    everything = ins + oos
    table = [
        ("in_scope_accuracy", F.col("correct_routes"), ins, None),
        ("out_of_scope_recall", tp, oos, None),
        ("out_of_scope_precision", tp, tp + fp, None),
        ("out_of_scope_false_accept_rate", F.col("false_accepts"), oos, F.when(F.col("out_of_scope_failures") > 0, "missing out-of-scope decisions")),
        ("in_scope_false_reject_rate", fp, ins, F.when(F.col("in_scope_failures") > 0, "missing in-scope decisions")),
        ("routing_precision", F.col("correct_routes"), routed, None),
        ("routing_coverage", routed, everything, None),
        ("failure_rate", F.col("in_scope_failures") + F.col("out_of_scope_failures"), everything, None),
    ]
    rows = [_rate(*x) for x in table]
    return c.select(F.inline(F.array(*rows)))


def _rate(name: str, n: Column, d: Column, reason: Column | None) -> Column:
    why = F.when(d == 0, "denominator is zero").otherwise(F.lit(None).cast("string") if reason is None else reason)
    low, high = wilson(n, d)
    keep = lambda x: F.when(why.isNull(), x)
    return F.struct(
        F.lit(name).alias("rate"), keep(ratio(n, d)).alias("value"), n.alias("numerator"), d.alias("denominator"), keep(low).alias("low"), keep(high).alias("high"), why.alias("reason")
    )


def reject_f1(c: DataFrame) -> DataFrame:
    """F1 of rejections; a missing answer to an out-of-scope example counts against it."""
    tp, fp = F.col("correct_rejections"), F.col("false_rejections")
    return c.select(ratio(2 * tp, 2 * tp + fp + (F.col("out_of_scope") - tp)).alias("out_of_scope_f1"))


def curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, recall, false_positive_rate, precision; scored: score, positive. Ties move together.

    Scores are first counted by value with map-side sums, then totalled from the top in blocks (running),
    so no task holds all thresholds.
    """
    by_score = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    every = by_score.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    out = running(by_score, "score", {"p": "tp", "n": "fp"}, descending=True).crossJoin(F.broadcast(every))
    return out.select(
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        "p",
        "n",
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("fp"), F.col("negatives")).alias("false_positive_rate"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        "positives",
        "negatives",
    )


def curve_areas(points: DataFrame) -> DataFrame:
    """auroc (trapezoids), average_precision (steps), fpr_at_95_recall; null without both kinds.

    The step before a point is known from the point's own tie group, so no lag over all points is needed.
    """
    fpr_step, recall_step = F.col("n") / F.col("negatives"), F.col("p") / F.col("positives")
    before = (F.col("tp") - F.col("p")) / F.col("positives")
    return points.agg(
        F.sum(fpr_step * (F.col("recall") + before) / 2).alias("auroc"),
        F.sum(recall_step * F.col("precision")).alias("average_precision"),
        F.min(F.when(F.col("recall") >= 0.95, F.col("false_positive_rate"))).alias("fpr_at_95_recall"),
    )


def unobserved(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels that no example has."""
    return labels.join(predictions.select(F.col("gold").alias("id")).distinct(), "id", "left_anti").select("id")

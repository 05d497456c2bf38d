"""Recorded runs: first attempts as predictions, integrity rules, comparison under provenance rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def first_attempts(attempts: DataFrame) -> DataFrame:
    """id, choice, run_complete: what was said first; a later failure still marks the run.

    attempts: id, repeat, choice (null: failed). The mark is one row, joined by broadcast.
    """
    state = attempts.agg((F.count_if(F.col("choice").isNull()) == 0).alias("run_complete"))
    return attempts.where("repeat = 0").select("id", "choice").crossJoin(F.broadcast(state))


def integrity(attempts: DataFrame, examples: DataFrame, repeats: int) -> DataFrame:
    """violation, n of a saved run: unknown, missing and repeated attempts, gaps, changed models, both result and error.

    attempts: id, repeat, choice, error_type, model, seconds.
    """
    a = attempts
    rows = a.agg(
        F.count_if(F.col("choice").isNotNull() & F.col("error_type").isNotNull()).alias("result_and_error"),
        F.count_if(F.col("choice").isNull() & F.col("error_type").isNull()).alias("neither"),
        F.count_if((F.col("repeat") < 0) | (F.col("repeat") >= repeats)).alias("repeat_out_of_range"),
        F.count_if(F.isnan("seconds") | (F.col("seconds") < 0) | F.col("seconds").isNull()).alias("bad_seconds"),
        F.greatest(F.size(F.collect_set("model")) - 1, F.lit(0)).cast("long").alias("changed_model"),
    )
    unknown = a.join(examples.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown_id"))
    again = a.groupBy("id", "repeat").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_attempt"))
    planned = a.where((F.col("repeat") >= 0) & (F.col("repeat") < repeats))
    missing = examples.select("id").join(planned.groupBy("id").agg(F.count_distinct("repeat").alias("n")), "id", "left").agg(F.sum(F.greatest(F.lit(repeats) - F.coalesce("n", F.lit(0)), F.lit(0))).alias("missing_attempt"))
    one = rows.crossJoin(unknown).crossJoin(again).crossJoin(missing)
    names = ["unknown_id", "repeated_attempt", "missing_attempt", "repeat_out_of_range", "result_and_error", "neither", "bad_seconds", "changed_model"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(n).cast("long").alias("n")) for n in names])))


def identity_changes(attempts: DataFrame) -> DataFrame:
    """Attempts whose model isn't that of their example's first answer."""
    w = Window.partitionBy("id").orderBy("repeat").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return attempts.withColumn("first_model", F.first("model", ignorenulls=True).over(w)).where("model <> first_model").select("id", "repeat", "model", "first_model")


def verify(recorded: DataFrame, recomputed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """metric, recorded, recomputed, agrees: a saved summary against the one that its predictions give; both one row."""
    names = recomputed.columns
    rows = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(name)) for n in names])))
    both = rows(recomputed, "recomputed").join(rows(recorded, "recorded"), "metric")
    a, b = F.col("recorded"), F.col("recomputed")
    return both.select("metric", "recorded", "recomputed", (a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b)), F.lit(False))).alias("agrees"))


def trial_gaps(observed: DataFrame, planned: DataFrame, warmups: int, samples: int) -> DataFrame:
    """run_id, case_id, gap of planned trials that aren't whole: missing, warmups, samples, invalid, several_models.

    observed: run_id, case_id, phase (warmup, sample), valid, model. planned: run_id, case_id; missing workers stay.
    """
    count = lambda phase: F.count_if(F.col("phase") == phase)
    got = observed.groupBy("run_id", "case_id").agg(count("warmup").alias("w"), count("sample").alias("s"), F.count_if(~F.col("valid")).alias("bad"), F.count_distinct("model").alias("models"))
    both = planned.join(got, ["run_id", "case_id"], "left")
    gaps = {"missing": F.col("w").isNull(), "warmups": F.col("w") != warmups, "samples": F.col("s") != samples, "invalid": F.col("bad") > 0, "several_models": F.col("models") > 1}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in gaps.items()]), lambda x: x.isNotNull())
    return both.select("run_id", "case_id", F.explode(found).alias("gap"))


TIMING_FACTORS = ["device", "dtype", "transport", "hardware"]


def native_compare(runs: DataFrame) -> DataFrame:
    """baseline and candidate side by side: accuracy delta, changed factors, latency ratio.

    runs: role (baseline, candidate), choice, gold, seconds and a column for each timing factor. The
    latency ratio is null unless every factor is known and equal on both sides.
    """
    roles = ("baseline", "candidate")
    right = F.coalesce(F.col("choice") == F.col("gold"), F.lit(False)).cast("double")
    per = []
    for r in roles:
        mine = F.col("role") == r
        per += [F.avg(F.when(mine, right)).alias(f"{r}_accuracy"), F.avg(F.when(mine, F.col("seconds"))).alias(f"{r}_seconds")]
        per += [F.max(F.when(mine, F.col(f))).alias(f"{r}_{f}") for f in TIMING_FACTORS]
    one = runs.agg(*per)
    changed = F.filter(F.array(*[F.when(~F.col(f"baseline_{f}").eqNullSafe(F.col(f"candidate_{f}")), F.lit(f)) for f in TIMING_FACTORS]), lambda x: x.isNotNull())
    known = F.lit(True)
    for f in TIMING_FACTORS:
        known = known & F.coalesce(F.col(f"baseline_{f}") == F.col(f"candidate_{f}"), F.lit(False))
    return one.select(
        (F.col("candidate_accuracy") - F.col("baseline_accuracy")).alias("accuracy_delta"),
        changed.alias("changed_factors"),
        F.when(known, ratio(F.col("baseline_seconds"), F.col("candidate_seconds"))).alias("latency_speedup"),
    )


QUALITY = ["accuracy", "top5_accuracy", "macro_f1", "balanced_accuracy", "weighted_f1", "matthews_correlation"]


def quality_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, baseline, candidate, delta of the six measures of quality; both: one row that has them. A measure that a side lacks has no delta."""
    long = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in QUALITY])))
    both = long(baseline, "baseline").join(long(candidate, "candidate"), "metric")
    return both.select("metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"))


def exclusions(runs: DataFrame, fixed: list[str], recipe: list[str], allow_recipe_change: bool = False) -> DataFrame:
    """run, reason: why a run can't be compared with the first (the least run_ord): a row for each reason, none for eligible runs.

    runs: run_ord, run, status and the columns of fixed (which must be the same) and recipe (which must be, unless a change is allowed). Nulls are
    equal to nulls. runs: a row a run, a handful.
    """
    first = runs.orderBy("run_ord").limit(1).select(*[F.col(c).alias(f"{c}_first_") for c in ("run_ord", "status", *fixed, *recipe)])
    both = runs.crossJoin(F.broadcast(first)).where(F.col("run_ord") != F.col("run_ord_first_"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"{c}_first_"))
    reasons = [F.when(~F.col("status").eqNullSafe("complete"), "not complete"), F.when(~F.col("status_first_").eqNullSafe("complete"), "baseline not complete")]
    reasons += [F.when(differs(c), f"{c} differs") for c in fixed]
    reasons += [] if allow_recipe_change else [F.when(differs(c), f"recipe changed: {c}") for c in recipe]
    return both.select("run", F.explode(F.filter(F.array(*reasons), lambda x: x.isNotNull())).alias("reason"))


def freeze_winner(trials: DataFrame) -> DataFrame:
    """The setting with the best development speed-up (the smaller setting wins ties), with its holdout speed-up only.

    trials: split (dev, holdout), setting, speedup.
    """
    best = trials.where("split = 'dev'").agg(F.max_by("setting", F.struct("speedup", -F.col("setting"))).alias("setting"), F.max("speedup").alias("dev_speedup"))
    held = trials.where("split = 'holdout'").select("setting", F.col("speedup").alias("holdout_speedup"))
    return F.broadcast(best).join(held, "setting", "left")

"""Classification metrics over recorded predictions. Missing choices stay in every denominator.

Predictions have gold and choice (null: failed or missing) and, where a metric needs them, shares. The
first step is always one grouped count with map-side sums; all that follows works on at most labels
times labels rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.vectors import total
from .decide import candidate_array, choice, prob_of, ranked_ids

FAILED = "__failed__"


def confusion(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """gold, predicted, n for all pairs of a label and a label or the failed column; labels: ord, id, at most 256."""
    counts = predictions.groupBy("gold", F.coalesce("choice", F.lit(FAILED)).alias("predicted")).agg(F.count("*").alias("n"))
    ids = F.transform("candidates", lambda c: c["id"])
    grid = candidate_array(labels).select(F.explode(ids).alias("gold"), "candidates").select("gold", F.explode(F.concat(ids, F.array(F.lit(FAILED)))).alias("predicted"))
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1 of a confusion matrix; 0 where undefined."""
    return _rates(_counts(matrix).where(F.col("label") != FAILED))


def _counts(matrix: DataFrame) -> DataFrame:
    """label, support, predicted, tp, the failed column too: each cell counts for its row and for its column, in one pass."""
    n, none = F.col("n"), F.lit(0).cast("long")
    row = F.struct(F.col("gold").alias("label"), n.alias("support"), none.alias("predicted"), F.when(F.col("gold") == F.col("predicted"), n).otherwise(none).alias("tp"))
    column = F.struct(F.col("predicted").alias("label"), none.alias("support"), n.alias("predicted"), none.alias("tp"))
    return matrix.select(F.inline(F.array(row, column))).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def _rates(counts: DataFrame) -> DataFrame:
    return counts.select(
        "label",
        "support",
        "predicted",
        "tp",
        ratio(F.col("tp"), F.col("predicted"), 0.0).alias("precision"),
        ratio(F.col("tp"), F.col("support"), 0.0).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0.0).alias("f1"),
    )


def summary(matrix: DataFrame) -> DataFrame:
    """One row of the classification summary of a confusion matrix."""
    label = F.col("label") != FAILED
    c = _rates(_counts(matrix)).withColumn("failures", F.when(~label, F.col("predicted")).otherwise(0))
    for name in ("support", "predicted", "tp", "precision", "recall", "f1"):
        c = c.withColumn(name, F.when(label, F.col(name)))
    s, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    one = c.agg(
        F.sum("failures").alias("failures"),
        F.sum("support").alias("examples"),
        F.sum("tp").alias("correct"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(s * F.col("f1")).alias("weighted_"),
        F.count_if(F.col("support") > 0).alias("labels_with_examples"),
        F.count_if((F.col("support") > 0) & (F.col("tp") == 0)).alias("zero_recall_labels"),
        F.count_if(F.col("predicted") > 0).alias("predicted_label_count"),
        F.max("predicted").alias("most_"),
        F.max("support").alias("major_"),
        F.count("support").alias("labels_"),
        F.sum(s * p).alias("sp_"),
        F.sum(s * s).alias("ss_"),
        F.sum(p * p).alias("pp_"),
    )
    n = F.col("examples").cast("double")
    covariance = F.col("correct") * n - F.col("sp_")
    spread = F.sqrt((n * n - F.col("ss_")) * (n * n - F.col("pp_") - F.col("failures").cast("double") ** 2))
    return one.select(
        "examples",
        "correct",
        F.col("failures").alias("failed_or_missing"),
        (F.col("correct") / n).alias("accuracy"),
        "macro_f1",
        "balanced_accuracy",
        (F.col("weighted_") / n).alias("weighted_f1"),
        ratio(covariance, spread, 0.0).alias("matthews_correlation"),
        "labels_with_examples",
        "zero_recall_labels",
        "predicted_label_count",
        (F.col("most_") / n).alias("largest_prediction_share"),
        (F.lit(1.0) / F.col("labels_")).alias("uniform_chance_accuracy"),
        (F.col("major_") / n).alias("majority_class_accuracy"),
    )


def with_evidence(predictions: DataFrame) -> DataFrame:
    """Adds what row-level metrics need: ranking, probability of the gold label and of the choice."""
    return predictions.withColumns({"ranking": ranked_ids(F.col("shares")), "p_gold": prob_of(F.col("shares"), F.col("gold")), "confidence": prob_of(F.col("shares"), F.col("choice"))})


def top_k(k: int) -> Column:
    return F.avg(F.array_contains(F.slice("ranking", 1, k), F.col("gold")).cast("double"))


def log_loss(epsilon: float = 1e-15) -> Column:
    return F.avg(-F.log(F.greatest(F.lit(epsilon), F.col("p_gold"))))


def brier() -> Column:
    return F.avg(total(F.transform("shares", lambda s: F.pow(s["prob"] - (s["id"] == F.col("gold")).cast("double"), F.lit(2.0)))))


def reliability_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """bin, lower, upper, examples, mean_confidence, accuracy; empty bins have nulls. The last bin is closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    got = predictions.groupBy(at.alias("bin")).agg(
        F.count("*").alias("examples"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("choice") == F.col("gold")).cast("double")).alias("accuracy")
    )
    every = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(got, "bin", "left")
    return out.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("examples", F.lit(0)).alias("examples"), "mean_confidence", "accuracy")


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("examples") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("examples")).alias("ece"))


def selective(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, selective_accuracy (null if nothing is accepted), coverage, in one pass over the predictions."""
    accepted = [F.col("confidence") >= F.lit(t) for t in thresholds]
    right = (F.col("choice") == F.col("gold")).cast("double")
    one = predictions.agg(*[F.struct(F.avg(F.when(a, right)).alias("a"), F.avg(F.coalesce(a, F.lit(False)).cast("double")).alias("c")).alias(f"t{i}") for i, a in enumerate(accepted)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}.a").alias("selective_accuracy"), F.col(f"t{i}.c").alias("coverage")) for i, t in enumerate(thresholds)])
    return one.select(F.inline(rows))


@dataclass(frozen=True)
class Metric:
    """A named aggregate over predictions. requires: None, "shares" or "ranking"; null unless all rows have it."""

    name: str
    value: Column
    requires: str | None = None
    direction: str = "higher"
    version: str = "1"
    parameters: dict = field(default_factory=dict)


def score_metrics(predictions: DataFrame, metrics: list[Metric]) -> DataFrame:
    """metric, value, direction, available, total, reason: all metrics in one aggregate, then turned to rows."""
    if not metrics or len({m.name for m in metrics}) != len(metrics):
        raise ValueError("at least one metric, with unique names")
    if bad := [m.name for m in metrics if not m.name.replace("_", "a").isalnum()]:
        raise ValueError(f"metric names are lower-case words: {bad}")
    has = {None: F.count("*"), "shares": F.count("shares"), "ranking": F.count("ranking")}
    one = predictions.agg(F.count("*").alias("total"), *[m.value.alias(f"v{i}") for i, m in enumerate(metrics)], *[has[m.requires].alias(f"a{i}") for i, m in enumerate(metrics)])
    rows = []
    for i, m in enumerate(metrics):
        full = F.col(f"a{i}") == F.col("total")
        value = F.when(full, F.col(f"v{i}").cast("double"))
        reason = F.when(~full, F.lit(f"requires {m.requires} for every example")).when(value.isNull(), F.lit("undefined for this input"))
        rows.append(F.struct(F.lit(m.name).alias("metric"), value.alias("value"), F.lit(m.direction).alias("direction"), F.col(f"a{i}").alias("available"), F.col("total").alias("total"), reason.alias("reason")))
    return one.select(F.inline(F.array(*rows)))


LEGACY = ["examples", "correct", "failed_or_missing", "accuracy", "macro_f1"]


def legacy_summary(summary_: DataFrame) -> DataFrame:
    """What reports of the first two schemas hold of a summary."""
    return summary_.select(*LEGACY)


def default_metrics() -> list[Metric]:
    """The row-level ones of the default set; the others come from summary()."""
    return [
        Metric("accuracy", F.avg(F.coalesce(F.col("choice") == F.col("gold"), F.lit(False)).cast("double"))),
        Metric("top3_accuracy", top_k(3), "ranking", parameters={"k": 3}),
        Metric("top5_accuracy", top_k(5), "ranking", parameters={"k": 5}),
        Metric("log_loss", log_loss(), "shares", "lower", parameters={"epsilon": 1e-15}),
        Metric("brier_score", brier(), "shares", "lower"),
    ]


def minimum_recall(classes: DataFrame) -> DataFrame:
    """Lowest recall over labels; null if a label has no examples."""
    return classes.agg(F.when(F.min("support") > 0, F.min("recall")).alias("minimum_recall"))


def cost(predictions: DataFrame, costs: dict[str, float], otherwise: float = 1.0) -> DataFrame:
    """Mean cost of errors, by gold label."""
    weight = F.lit(otherwise)
    for label, c in costs.items():
        weight = F.when(F.col("gold") == label, F.lit(c)).otherwise(weight)
    wrong = ~F.coalesce(F.col("choice") == F.col("gold"), F.lit(False))
    return predictions.agg(F.avg(F.when(wrong, weight).otherwise(0.0)).alias("error_cost"))


def case_metrics(answers: DataFrame) -> DataFrame:
    """case_id, exact_match, question_accuracy of answers (case_id, choice, accepted array of ids)."""
    right = F.coalesce(F.array_contains("accepted", F.col("choice")), F.lit(False))
    return answers.groupBy("case_id").agg(F.every(right).alias("exact_match"), F.avg(right.cast("double")).alias("question_accuracy"), F.count("*").alias("questions"))


def choose(df: DataFrame) -> DataFrame:
    return df.withColumn("choice", choice(F.col("shares")))

"""Metrics over predictions: classification, calibration, comparison, ranking, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import csv_safe
from ..functions.vectors import dot
from ..operators import classify, compare, decide, ranking, routing
from ..plans.fixtures import REJECT, centroid_predictions, centroids, labels, predictions, protos, scored, table, with_missing
from .registry import CENTROIDS, MATRIX, SCORES, mcnemar_sql, query, wilson_sql


def matrix(spark, d):
    return classify.confusion(with_missing(predictions(spark, d)), labels(spark, d))


@query(f"WITH {SCORES}{MATRIX} SELECT gold, predicted, n FROM matrix")
def confusion_matrix(spark, d):
    return matrix(spark, d)


@query(f"WITH {SCORES}{MATRIX} SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def per_class_prf(spark, d):
    return classify.per_class(matrix(spark, d))


SUMMARY = f"""WITH {SCORES}{MATRIX},
    t AS (SELECT sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS c, sum(support * predicted)::DOUBLE AS sp, sum(support * support)::DOUBLE AS ss, sum(predicted * predicted)::DOUBLE AS pp FROM prf),
    f AS (SELECT sum(n)::DOUBLE AS failures FROM matrix WHERE predicted = '__failed__')
    SELECT sum(support)::BIGINT AS examples, sum(tp)::BIGINT AS correct, any_value(failures)::BIGINT AS failed_or_missing, round(any_value(c / n), 6) AS accuracy,
    round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(support * f1) / any_value(n), 6) AS weighted_f1,
    round(any_value(coalesce((c * n - sp) / nullif(sqrt((n * n - ss) * (n * n - pp - failures * failures)), 0), 0)), 6) AS matthews_correlation,
    count(*) FILTER (support > 0) AS labels_with_examples, count(*) FILTER (support > 0 AND tp = 0) AS zero_recall_labels, count(*) FILTER (predicted > 0) AS predicted_label_count,
    round(max(predicted) / any_value(n), 6) AS largest_prediction_share, round(1.0::DOUBLE / count(*), 6) AS uniform_chance_accuracy, round(max(support) / any_value(n), 6) AS majority_class_accuracy
    FROM prf, t, f"""


@query(SUMMARY)
def classification_summary(spark, d):
    return classify.summary(matrix(spark, d))


@query(f"WITH {SCORES} SELECT round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 3)::INT), 6) AS top3, round(avg((rank <= 5)::INT), 6) AS top5 FROM scores WHERE cand = gold")
def topk_accuracy(spark, d):
    return predictions(spark, d).agg(*[classify.top_k(k).alias(f"top{k}") for k in (1, 3, 5)])


@query(
    f"""WITH {SCORES} SELECT (SELECT round(avg(-ln(greatest(1e-15, prob))), 6) FROM scores WHERE cand = gold) AS log_loss,
    (SELECT round(avg(b), 6) FROM (SELECT sum((prob - (cand = gold)::INT) ** 2) AS b FROM scores GROUP BY vec_id)) AS brier"""
)
def log_loss_brier(spark, d):
    return predictions(spark, d).agg(classify.log_loss().alias("log_loss"), classify.brier().alias("brier"))


BINS = f"""{SCORES}, bins AS (
    SELECT b::BIGINT AS bin, b / 10 AS lower, (b + 1) / 10 AS upper, count(p.vec_id) AS examples, avg(confidence) AS mean_confidence, avg((choice = gold)::INT) AS accuracy
    FROM range(10) r(b) LEFT JOIN preds p ON least(floor(confidence * 10), 9) = b GROUP BY b)"""


@query(f"WITH {BINS} SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, examples, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM bins")
def reliability_bins(spark, d):
    return classify.reliability_bins(predictions(spark, d))


@query(f"WITH {BINS} SELECT round(sum(examples * abs(accuracy - mean_confidence)) / sum(examples), 6) AS ece FROM bins")
def ece(spark, d):
    return classify.expected_calibration_error(classify.reliability_bins(predictions(spark, d)))


@query(
    f"""WITH {SCORES} SELECT t AS threshold, round(avg((choice = gold)::INT) FILTER (confidence >= t), 6) AS selective_accuracy, round(avg((confidence >= t)::INT), 6) AS coverage
    FROM preds CROSS JOIN (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS t) GROUP BY t"""
)
def selective_accuracy_coverage(spark, d):
    return classify.selective(predictions(spark, d), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


METRICS = f"""WITH {SCORES}, n AS (SELECT count(*) AS total, count(*) FILTER (vec_id % 17 <> 0) AS available FROM preds)
    SELECT 'accuracy' AS metric, round((SELECT avg(coalesce(choice = gold, false)::INT) FROM missing), 6) AS value, 'higher' AS direction, total AS available, total, NULL::VARCHAR AS reason FROM n
    UNION ALL SELECT 'top3_accuracy', round((SELECT avg((rank <= 3)::INT) FROM scores WHERE cand = gold), 6), 'higher', total, total, NULL FROM n
    UNION ALL SELECT 'top5_accuracy', round((SELECT avg((rank <= 5)::INT) FROM scores WHERE cand = gold), 6), 'higher', total, total, NULL FROM n
    UNION ALL SELECT 'log_loss', NULL, 'lower', available, total, 'requires shares for every example' FROM n
    UNION ALL SELECT 'brier_score', NULL, 'lower', available, total, 'requires shares for every example' FROM n"""


def partly_evidenced(spark, d):
    p = with_missing(predictions(spark, d))
    return p.withColumn("shares", F.when(F.col("choice").isNotNull(), F.col("shares")))


@query(METRICS)
def metric_availability(spark, d):
    return classify.score_metrics(partly_evidenced(spark, d), classify.default_metrics())


@query(METRICS.replace("SELECT 'accuracy' AS metric,", "SELECT * REPLACE (CASE WHEN metric = 'accuracy' THEN '''=accuracy' ELSE metric END AS metric) FROM (SELECT 'accuracy' AS metric,", 1) + ")")
def long_form_metrics(spark, d):
    """The metrics as a sheet, with cells that can't be taken for formulas."""
    m = classify.score_metrics(partly_evidenced(spark, d), classify.default_metrics())
    named = F.when(F.col("metric") == "accuracy", F.concat(F.lit("="), F.col("metric"))).otherwise(F.col("metric"))
    return m.withColumn("metric", csv_safe(named))


@query(
    f"""WITH {SCORES}{MATRIX} SELECT (SELECT CASE WHEN min(support) > 0 THEN round(min(recall), 6) END FROM prf) AS minimum_recall,
    (SELECT round(avg(CASE WHEN coalesce(choice = gold, false) THEN 0 WHEN gold = 'L9' THEN 5 WHEN gold = 'L0' THEN 2 ELSE 1 END), 6) FROM missing) AS error_cost"""
)
def custom_cost_min_recall(spark, d):
    return classify.minimum_recall(classify.per_class(matrix(spark, d))).crossJoin(classify.cost(with_missing(predictions(spark, d)), {"L0": 2.0, "L9": 5.0}))


@query(
    """WITH a AS (SELECT l.doc_id AS case_id, (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) = quality AS q1, toxic = 0 AS q2 FROM labels l JOIN documents USING (doc_id))
    SELECT case_id, q1 AND q2 AS exact_match, round((q1::INT + q2::INT) / 2, 6) AS question_accuracy, 2::BIGINT AS questions FROM a"""
)
def multi_question_case_metrics(spark, d):
    """Two questions a document: is it good (guessed from its length), is it clean (guessed yes)."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = F.when(F.col("n_chars") > 500, "1").otherwise("0")
    two = F.array(F.struct(guess.alias("choice"), F.array(F.col("quality").cast("string")).alias("accepted")), F.struct(F.lit("0").alias("choice"), F.array(F.col("toxic").cast("string")).alias("accepted")))
    return classify.case_metrics(rows.select(F.col("doc_id").alias("case_id"), F.inline(two)))


def both_systems(spark, d):
    a = predictions(spark, d).select(F.col("vec_id").alias("id"), "gold", "choice")
    b = centroid_predictions(spark, d).select(F.col("vec_id").alias("id"), "gold", "choice")
    return a, b


PAIRS = f"""{SCORES}{CENTROIDS}, pairs AS (SELECT vec_id, a.gold, CASE WHEN a.choice = a.gold AND b.choice = a.gold THEN 'both_correct' WHEN a.choice <> a.gold AND b.choice = a.gold THEN 'fixed'
    WHEN a.choice = a.gold THEN 'regressed' ELSE 'both_wrong' END AS outcome FROM preds a JOIN cpreds b USING (vec_id)),
    counted AS (SELECT o AS outcome, count(vec_id) AS n FROM (SELECT unnest(['both_correct', 'fixed', 'regressed', 'both_wrong']) AS o) LEFT JOIN pairs ON outcome = o GROUP BY o)"""


@query(f"WITH {PAIRS} SELECT outcome, n FROM counted")
def paired_outcomes(spark, d):
    return compare.outcome_counts(compare.paired(*both_systems(spark, d)))


@query(f"WITH {PAIRS} SELECT vec_id AS id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY vec_id) AS n FROM pairs QUALIFY n <= 10")
def paired_first_cases(spark, d):
    return compare.first_cases(compare.paired(*both_systems(spark, d))).select("id", "outcome", "n")


LOW, HIGH = wilson_sql("correct", "total")


@query(
    f"""WITH {SCORES}, g AS (SELECT gold, count(*) FILTER (choice = gold) AS correct, count(*) AS total FROM missing GROUP BY gold)
    SELECT gold, correct, total, round(correct / total, 6) AS accuracy, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM g"""
)
def wilson_intervals(spark, d):
    return compare.accuracy_interval(with_missing(predictions(spark, d)), "gold")


@query(f"WITH {PAIRS}, k AS (SELECT max(n) FILTER (outcome = 'fixed') AS f, max(n) FILTER (outcome = 'regressed') AS r FROM counted) SELECT f AS fixed, r AS regressed, round({mcnemar_sql('f', 'r')}, 6) AS p_value FROM k")
def mcnemar_exact(spark, d):
    return compare.test_pairs(compare.paired(*both_systems(spark, d)))


@query(
    f"""WITH {SCORES}{CENTROIDS}, runs AS (SELECT 0 AS o, 'prototype' AS run, vec_id, gold, choice FROM preds UNION ALL SELECT 1, 'centroid', vec_id, gold, choice FROM cpreds
        UNION ALL SELECT 2, 'constant', vec_id, gold, 'L0' FROM preds UNION ALL SELECT 3, 'partial', vec_id, gold, choice FROM missing),
    x AS (SELECT r.o, r.run, coalesce(r.choice = r.gold, false) AS b, p.choice = p.gold AS a, r.choice IS NULL AS m FROM runs r JOIN preds p USING (vec_id)),
    per AS (SELECT o, run, avg(b::INT) AS accuracy, avg(a::INT) AS base, count(*) FILTER (NOT a AND b) AS fixed, count(*) FILTER (a AND NOT b) AS regressed, o > 0 AND count(*) FILTER (m) = 0 AS eligible FROM x GROUP BY o, run)
    SELECT run, round(accuracy, 6) AS accuracy, round(accuracy - base, 6) AS delta, fixed, regressed, eligible, CASE WHEN eligible THEN round({mcnemar_sql('fixed', 'regressed')}, 6) END AS p_value,
        CASE WHEN eligible THEN round(least(1, {mcnemar_sql('fixed', 'regressed')} * (SELECT count(*) FROM per WHERE eligible)), 6) END AS p_bonferroni FROM per"""
)
def benchmark_deltas(spark, d):
    """Three systems and a partial run against the first."""
    rows = scored(spark, d).select("vec_id", "gold", "vector", decide.choice(F.col("shares")).alias("prototype"))
    beside = decide.beside(rows, centroids(spark, d), "vector")
    near = F.transform("candidates", lambda c: F.struct(c["ord"].alias("ord"), c["id"].alias("id"), dot(F.col("vector"), c["vector"]).alias("score")))
    partial = F.when(F.col("vec_id") % 17 != 0, F.col("prototype"))
    every = beside.select("gold", "prototype", decide.choice(near).alias("centroid"), F.lit("L0").alias("constant"), partial.alias("partial"))
    return compare.benchmark_beside(every, ["prototype", "centroid", "constant", "partial"])


@query(
    f"""WITH {SCORES}, r AS (SELECT vec_id, max(rank) FILTER (cand = gold) AS p, max(ord + 1) FILTER (cand = gold) AS q FROM scores GROUP BY vec_id)
    SELECT round(avg((p = 1)::INT), 6) AS top1, round(avg((p <= 3)::INT), 6) AS hit_at_k, round(avg((p <= 3)::INT), 6) AS recall_at_k, round(avg(1 / p), 6) AS mrr,
    round(avg((q = 1)::INT), 6) AS input_order_top1, round(avg(1 / q), 6) AS input_order_mrr FROM r"""
)
def ir_metrics_binary(spark, d):
    """The gold label is the one relevant candidate; beside it what the submitted order would have had."""
    s = scored(spark, d)
    gold = F.array("gold")
    by_score = ranking.closed_world(decide.ranked_ids(F.col("shares")), gold, 3)
    by_order = ranking.closed_world(F.transform("shares", lambda x: x["id"]), gold, 3)
    return s.agg(*[F.avg(c).alias(n) for n, c in by_score.items()], F.avg(by_order["top1"]).alias("input_order_top1"), F.avg(by_order["mrr"]).alias("input_order_mrr"))


@query(
    f"""WITH {SCORES}, r AS (SELECT vec_id, max(rank) FILTER (cand = gold) AS p, count(*) AS n FROM scores GROUP BY vec_id)
    SELECT vec_id, (p = 1)::INT::DOUBLE AS top1, CASE WHEN p <= 3 THEN 1::DOUBLE END AS hit_at_k, CASE WHEN p <= 3 THEN 1::DOUBLE END AS known_recall_at_k, CASE WHEN p <= 3 THEN round(1 / p, 6) END AS reciprocal_rank,
    NULL::DOUBLE AS ndcg_at_k, NULL::DOUBLE AS judged_fraction_at_k FROM r"""
)
def ir_prefix_incomplete(spark, d):
    """A recorded prefix of three results assessed at five: what the unseen tail could change is unknown."""
    s = scored(spark, d).withColumn("ranked", F.slice(decide.ranked_ids(F.col("shares")), 1, 3))
    s = s.withColumn("judgments", F.map_from_arrays(F.transform("shares", lambda x: x["id"]), F.transform("shares", lambda x: (x["id"] == F.col("gold")).cast("int"))))
    m = ranking.assess(F.col("ranked"), F.col("judgments"), 5, complete=False)
    return s.select("vec_id", *[m[c].alias(c) for c in ranking.REASONS])


ROUTE = f"""{SCORES}, c AS (SELECT count(*) FILTER (gold <> 'L9') AS in_scope, count(*) FILTER (gold = 'L9') AS out_of_scope, count(*) FILTER (gold <> 'L9' AND choice = gold) AS correct_routes,
    count(*) FILTER (gold <> 'L9' AND choice <> gold AND choice <> 'L9') AS wrong_routes, count(*) FILTER (gold <> 'L9' AND choice = 'L9') AS false_rejections,
    count(*) FILTER (gold = 'L9' AND choice = 'L9') AS correct_rejections, count(*) FILTER (gold = 'L9' AND choice <> 'L9') AS false_accepts,
    count(*) FILTER (gold <> 'L9' AND choice IS NULL) AS in_scope_failures, count(*) FILTER (gold = 'L9' AND choice IS NULL) AS out_of_scope_failures FROM missing)"""
R_LOW, R_HIGH = wilson_sql("numerator", "denominator")
RATES = [
    ("in_scope_accuracy", "correct_routes", "in_scope", "NULL"),
    ("out_of_scope_recall", "correct_rejections", "out_of_scope", "NULL"),
    ("out_of_scope_precision", "correct_rejections", "correct_rejections + false_rejections", "NULL"),
    ("out_of_scope_false_accept_rate", "false_accepts", "out_of_scope", "CASE WHEN out_of_scope_failures > 0 THEN 'missing out-of-scope decisions' END"),
    ("in_scope_false_reject_rate", "false_rejections", "in_scope", "CASE WHEN in_scope_failures > 0 THEN 'missing in-scope decisions' END"),
    ("routing_precision", "correct_routes", "correct_routes + wrong_routes + false_accepts", "NULL"),
    ("routing_coverage", "correct_routes + wrong_routes + false_accepts", "in_scope + out_of_scope", "NULL"),
    ("failure_rate", "in_scope_failures + out_of_scope_failures", "in_scope + out_of_scope", "NULL"),
]
ALL_RATES = " UNION ALL ".join(f"SELECT '{n}' AS rate, {a} AS numerator, {b} AS denominator, CASE WHEN {b} = 0 THEN 'denominator is zero' ELSE {w} END AS reason FROM c" for n, a, b, w in RATES)


@query(f"WITH {ROUTE} SELECT * FROM c")
def routing_counts(spark, d):
    return routing.counts(with_missing(predictions(spark, d)), REJECT)


@query(
    f"""WITH {ROUTE}, r AS ({ALL_RATES}) SELECT rate, CASE WHEN reason IS NULL THEN round(numerator / denominator, 6) END AS value, numerator, denominator,
    CASE WHEN reason IS NULL THEN round({R_LOW}, 6) END AS low, CASE WHEN reason IS NULL THEN round({R_HIGH}, 6) END AS high, reason FROM r"""
)
def routing_rates(spark, d):
    return routing.rates(routing.counts(with_missing(predictions(spark, d)), REJECT))


@query(f"WITH {ROUTE} SELECT round(2 * correct_rejections / nullif(2 * correct_rejections + false_rejections + out_of_scope - correct_rejections, 0), 6) AS out_of_scope_f1 FROM c")
def oos_f1(spark, d):
    return routing.reject_f1(routing.counts(with_missing(predictions(spark, d)), REJECT))


CURVE = f"""{SCORES}, s AS (SELECT round(prob, 4) AS score, gold = 'L9' AS positive FROM scores WHERE cand = 'L9'),
    g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s GROUP BY score),
    t AS (SELECT score AS threshold, p, n, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS fp, sum(p) OVER ()::DOUBLE AS pos, sum(n) OVER ()::DOUBLE AS neg FROM g)"""


def rejection_scores(spark, d):
    """Rounded, so that there are ties."""
    return scored(spark, d).select(F.round(decide.prob_of(F.col("shares"), REJECT), 4).alias("score"), (F.col("gold") == REJECT).alias("positive"))


@query(f"WITH {CURVE} SELECT round(threshold, 6) AS threshold, tp, fp, round(tp / pos, 6) AS recall, round(fp / neg, 6) AS false_positive_rate, round(tp / (tp + fp), 6) AS precision FROM t")
def oos_curve(spark, d):
    return routing.curve(rejection_scores(spark, d)).select("threshold", "tp", "fp", "recall", "false_positive_rate", "precision")


@query(
    f"""WITH {CURVE} SELECT round(sum(n / neg * (tp / pos + (tp - p) / pos) / 2), 6) AS auroc, round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision,
    round(min(fp / neg) FILTER (tp / pos >= 0.95), 6) AS fpr_at_95_recall FROM t"""
)
def oos_auroc_ap_fpr95(spark, d):
    return routing.curve_areas(routing.curve(rejection_scores(spark, d)))


@query("SELECT l AS id FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it', 'pt']) AS l) WHERE l NOT IN (SELECT lang FROM documents)")
def unobserved_labels(spark, d):
    every = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it", "pt")], "id string")
    return routing.unobserved(every, table(spark, d, "documents").select(F.col("lang").alias("gold")))


@query(f"WITH {SCORES} SELECT ord::BIGINT AS ord, cand AS id, proto_id FROM protos")
def candidate_prototypes(spark, d):
    return protos(spark, d).select("ord", "id", "proto_id")

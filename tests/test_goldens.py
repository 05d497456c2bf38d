"""Hand-checked values."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import classify, compare, decide, prepare, rag, ranking, routing, timing, validate
from plumbline.operators.running import running


def one(df):
    return df.collect()[0]


def labelled(spark, ids):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "ord int, id string")


def test_classification_summary(spark):
    p = spark.createDataFrame(list(zip("aaaabbc", "aabbbcc", strict=True)), "gold string, choice string")
    r = one(classify.summary(classify.confusion(p, labelled(spark, "abc"))))
    assert r.accuracy == pytest.approx(4 / 7)
    assert r.balanced_accuracy == pytest.approx(2 / 3)
    assert r.macro_f1 == pytest.approx(26 / 45)
    assert r.weighted_f1 == pytest.approx(62 / 105)
    assert r.matthews_correlation == pytest.approx(12 / math.sqrt(896))
    assert (r.largest_prediction_share, r.majority_class_accuracy, r.uniform_chance_accuracy) == pytest.approx((3 / 7, 4 / 7, 1 / 3))
    r = one(classify.summary(classify.confusion(p, labelled(spark, "abcd"))))
    assert r.macro_f1 == pytest.approx(13 / 30)
    assert r.uniform_chance_accuracy == 0.25
    assert r.balanced_accuracy == pytest.approx(2 / 3)


def test_missing_choices_stay_in_the_denominator(spark):
    p = spark.createDataFrame([("a", "a"), ("a", None)], "gold string, choice string")
    r = one(classify.summary(classify.confusion(p, labelled(spark, "ab"))))
    assert (r.accuracy, r.failed_or_missing, r.predicted_label_count) == (0.5, 1, 1)


def shares(spark):
    rows = [(g, [(0, "a", 0.0, p), (1, "b", 0.0, 1 - p)], c) for g, p, c in zip("abba", (0.8, 0.4, 0.7, 0.1), "abab", strict=True)]
    df = spark.createDataFrame(rows, "gold string, shares array<struct<ord int, id string, score double, prob double>>, choice string")
    return df.withColumn("p_gold", decide.prob_of(F.col("shares"), F.col("gold"))).withColumn("confidence", decide.prob_of(F.col("shares"), F.col("choice")))


def test_probability_metrics(spark):
    p = shares(spark)
    r = one(p.agg(classify.log_loss().alias("l"), classify.brier().alias("b")))
    assert r.l == pytest.approx(-math.log(0.8 * 0.6 * 0.3 * 0.1) / 4)
    assert r.b == pytest.approx((0.08 + 0.32 + 0.98 + 1.62) / 4)
    assert one(classify.expected_calibration_error(classify.reliability_bins(p, 10))).ece == pytest.approx((0.2 + 0.4 + 0.7 + 0.9) / 4)
    assert one(classify.expected_calibration_error(classify.reliability_bins(p, 1))).ece == pytest.approx(0.25)
    a, b = sorted(classify.selective(p, [0.75, 1.0]).collect())
    assert (a.selective_accuracy, a.coverage) == (0.5, 0.5)
    assert (b.selective_accuracy, b.coverage) == (None, 0.0)


def test_ties_go_to_the_first_in_order(spark):
    states = spark.createDataFrame([(1,)], "id int")
    c = spark.createDataFrame([(1, "z", 2.0), (0, "y", 2.0), (2, "a", 1.0)], "ord int, id string, s double")
    s = decide.score(states, c, lambda x: x["s"], "s")
    r = one(s.select(decide.choice(F.col("shares")).alias("c"), decide.ranked_ids(F.col("shares")).alias("r")))
    assert (r.c, r.r) == ("y", ["y", "z", "a"])


def test_scores_must_be_finite_and_candidates_bounded(spark):
    states = spark.createDataFrame([(1,)], "id int")
    c = spark.createDataFrame([(0, "a", float("nan"))], "ord int, id string, s double")
    with pytest.raises(Exception, match="finite"):
        decide.score(states, c, lambda x: x["s"], "s").collect()
    many = spark.range(257).select(F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("id"), F.lit(1.0).alias("s"))
    with pytest.raises(Exception, match="256"):
        decide.score(states, many, lambda x: x["s"], "s").collect()


def assess(spark, ranked, judgments, k, complete=True):
    df = spark.createDataFrame([(ranked, judgments)], "r array<string>, j map<string,int>")
    m = ranking.assess(F.col("r"), F.col("j"), k, complete)
    return one(df.select(*[c.alias(n) for n, c in m.items()], ranking.reasons(m).alias("why")))


def test_ranking(spark):
    r = assess(spark, ["b", "a", "c"], {"a": 1, "b": 0, "c": 1, "d": 1}, 2)
    assert (r.top1, r.hit_at_k, r.known_recall_at_k, r.reciprocal_rank, r.judged_fraction_at_k) == (0, 1, pytest.approx(1 / 3), 0.5, 1)
    x = 1 / math.log2(3)
    assert r.ndcg_at_k == pytest.approx(x / (1 + x))
    r = assess(spark, ["u", "a"], {"a": 1}, 2)
    assert (r.top1, r.reciprocal_rank, r.ndcg_at_k, r.hit_at_k, r.known_recall_at_k, r.judged_fraction_at_k) == (None, None, None, 1, 1, 0.5)
    assert set(r.why) == {"top1", "reciprocal_rank", "ndcg_at_k"}
    r = assess(spark, ["u", "a"], {"a": 1}, 1)
    assert (r.hit_at_k, r.known_recall_at_k) == (None, 0)
    r = assess(spark, [], {"a": 1}, 3)
    assert (r.top1, r.hit_at_k, r.known_recall_at_k, r.reciprocal_rank, r.judged_fraction_at_k) == (0, 0, 0, 0, None)
    r = assess(spark, ["x"], {"a": 1, "x": 0}, 3, complete=False)
    assert (r.hit_at_k, r.known_recall_at_k, r.reciprocal_rank) == (None, None, None)


def test_routing(spark):
    gold = ["a"] * 4 + ["oos"] * 3
    choice = ["a", "b", "oos", None, "oos", "a", None]
    c = routing.counts(spark.createDataFrame(list(zip(gold, choice, strict=True)), "gold string, choice string"), "oos")
    assert tuple(one(c)) == (4, 3, 1, 1, 1, 1, 1, 1, 1)
    assert one(routing.reject_f1(c)).out_of_scope_f1 == pytest.approx(2 / 5)
    r = {x.rate: x for x in routing.rates(c).collect()}
    assert r["in_scope_accuracy"].value == 0.25
    assert r["out_of_scope_recall"].value == pytest.approx(1 / 3)
    assert r["out_of_scope_precision"].value == 0.5
    assert r["routing_precision"].value == pytest.approx(1 / 3)
    assert r["routing_coverage"].value == pytest.approx(3 / 7)
    assert r["failure_rate"].value == pytest.approx(2 / 7)
    assert r["out_of_scope_false_accept_rate"].value is None
    assert r["in_scope_false_reject_rate"].reason == "missing in-scope decisions"


def test_curve_moves_ties_together(spark):
    s = spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True), (0.1, False)], "score double, positive boolean")
    points = routing.curve(s)
    assert sorted((r.threshold, r.tp, r.fp) for r in points.collect()) == [(0.1, 2, 2), (0.5, 2, 1), (0.9, 1, 0)]
    r = one(routing.curve_areas(points))
    assert r.auroc == pytest.approx(0.875)
    assert r.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert r.fpr_at_95_recall == 0.5


def test_rag_evidence(spark):
    df = spark.createDataFrame(
        [(["c", "a", "b"], ["c"], [["a", "b"], ["c"]], {"a": "A!", "b": "B!"}, "has c only")],
        "rr array<string>, cx array<string>, routes array<array<string>>, texts map<string,string>, context string",
    )
    r = one(
        df.select(
            rag.source_coverage(F.col("rr"), F.col("routes")).alias("a"),
            rag.reranking_coverage(F.col("rr"), F.lit(True), F.col("rr"), F.col("routes"), 1).alias("b"),
            rag.source_coverage(F.col("cx"), F.col("routes")).alias("c"),
            rag.text_retained(F.col("context"), F.col("routes"), F.col("texts")).alias("d"),
            rag.text_retained(F.col("context"), F.slice("routes", 1, 1), F.col("texts")).alias("e"),
        )
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (True, True, True, None, False)
    df = spark.createDataFrame([(["x"], ["x", "a", "b"], [["a", "b"]])], "r array<string>, i array<string>, routes array<array<string>>")
    at = lambda k: one(df.select(rag.reranking_coverage(F.col("r"), F.lit(False), F.col("i"), F.col("routes"), k).alias("v"))).v
    assert (at(1), at(2), at(3)) == (False, False, None)


def test_rag_gates(spark):
    v = spark.createDataFrame([("m", -2.0), ("m", 8.0), ("m", None)], "metric string, value double")
    s = rag.metric_summary(v, spark.createDataFrame([(2,)], "eligible long"))
    r = one(s)
    assert (r["mean"], r.minimum, r.maximum, r["stddev"], r.coverage) == (3, -2, 8, 5, 1)
    rules = "metric string, minimum double, maximum double, min_coverage double"
    assert one(rag.gates(s, spark.createDataFrame([("m", 2.5, 3.5, 1.0)], rules))).status == "passed"
    assert one(rag.gates(s, spark.createDataFrame([("m", None, 2.9, 1.0)], rules))).status == "failed"
    part = rag.metric_summary(v, spark.createDataFrame([(3,)], "eligible long"))
    assert one(rag.gates(part, spark.createDataFrame([("m", None, 3.5, 1.0)], rules))).status == "unknown"


def test_latency(spark):
    d = lambda xs: one(spark.createDataFrame([(float(x),) for x in xs], "s double").agg(*timing.distribution(F.col("s")))).p95_seconds
    assert d(range(1, 21)) == pytest.approx(19.05)
    assert d([1, 2]) is None


def test_mcnemar(spark):
    pairs = [(53, 34), (0, 0), (5, 5), (10, 0), (3, 1), (1, 200), (400, 350)]
    rows = spark.createDataFrame(pairs, "f long, r long").select("f", "r", stats.mcnemar(F.col("f"), F.col("r")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(stats.mcnemar_exact(r.f, r.r), abs=1e-12)
    assert stats.mcnemar_exact(53, 34) == pytest.approx(0.053003, abs=1e-6)


def test_wilson_ends(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(0, 5), (5, 5), (0, 0)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert (r[0].a, r[1].b, r[2].a) == (0.0, 1.0, None)


def test_speedup_and_bootstrap(spark):
    rows = [(s, f"p{r}", f"c{c}", (1.25 if s == "baseline" else 1.0) * (c + 1)) for s in ("baseline", "candidate") for r in range(3) for c in range(2) for _ in range(3)]
    t = spark.createDataFrame(rows, "system string, run_id string, case_id string, seconds double")
    assert one(compare.speed_report(compare.speedups(t))).geomean_speedup == pytest.approx(1.25)
    r = one(compare.bootstrap_speedup(t, resamples=20))
    assert (r.low, r.high, r.resamples) == (pytest.approx(1.25), pytest.approx(1.25), 20)


def test_seeded_order_is_the_mersenne_shuffle(spark):
    want = list(range(10))
    random.Random(7).shuffle(want)
    got = [r.id for r in compare.seeded_order(spark, list(range(10)), 7).orderBy("exec_ord").collect()]
    assert got == want


def test_audit(spark):
    rows = [("s", "t1", "x"), ("s", "t1", "y"), ("s", "t2", "x"), ("s", "t3", "x"), ("u", "t1", "x"), ("u", "t9", "x")]
    df = spark.createDataFrame(rows, "split string, text string, label string")
    r = {x.split: x for x in prepare.audit_within(df, F.col("text")).collect()}["s"]
    assert (r.distinct_keys, r.groups, r.rows, r.pairs, r.conflicts) == (3, 1, 2, 1, 1)
    b = one(prepare.audit_between(df, F.col("text"), ["s", "u"]))
    assert (b.groups, b.left_rows, b.right_rows, b.pairs) == (1, 2, 1, 2)


def test_noul_texts(spark):
    df = spark.createDataFrame([("Is it?", None, "")], "i string, f string, t string")
    c = one(df.select(decide.noul_candidates(F.col("i"), F.col("f"), F.col("t")).alias("c"))).c
    assert [x.text for x in c] == ["false: No. This is false: Is it?", "true: Yes. This is true: Is it?"]


def test_unicode(spark):
    df = spark.createDataFrame([("  Straße x ",)], "t string")
    r = one(df.select(T.strip(F.col("t")).alias("s"), T.casefold_collapse("t").alias("c"), T.compatible_collapse("t").alias("n"), T.tokens(F.col("t")).alias("k")))
    assert (r.s, r.c, r.n, r.k) == ("Straße x", "strasse x", "strasse x", ["straße", "x"])
    assert T.canonical_json({"b": 1e-7, "a": "é"}) == '{"b":1e-07,"a":"é"}'


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0], [3.0, 0.0]])], "v array<double>, q array<array<double>>, d array<array<double>>")
    r = one(df.select(V.l2_normalise(F.col("v")).alias("n"), V.maxsim(F.col("q"), F.col("d")).alias("m"), V.scaled_rms_difference(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))).alias("r")))
    assert r.n == pytest.approx([0.6, 0.8])
    assert r.m == 5.0
    assert r.r == pytest.approx(math.sqrt(12.5))


def test_request_limits(spark):
    rows = [(1, "s", "q", "i", f"c{i}", "t") for i in range(300)] + [(2, "s", "q", "i", "c", " ")] + [(3, "s", "q", "i", "c", "ok")]
    r = {x.request_id: x.violations for x in validate.request_limits(spark.createDataFrame(rows, "request_id int, state string, question_id string, instructions string, id string, text string")).collect()}
    assert r == {1: ["candidates"], 2: ["blank"], 3: []}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=60, unique_by=lambda x: x[0]), st.booleans())
def test_running_totals(spark, rows, down):
    df = spark.createDataFrame([(float(a), b) for a, b in rows], "k double, n long")
    got = {r.k: r.t for r in running(df, "k", {"n": "t"}, descending=down, blocks=5).collect()}
    want, total = {}, 0
    for a, b in sorted(rows, reverse=down):
        total += b
        want[float(a)] = total
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["a", "b", "c", None])), min_size=1, max_size=30))
def test_summary_against_fractions(spark, pairs):
    r = one(classify.summary(classify.confusion(spark.createDataFrame(pairs, "gold string, choice string"), labelled(spark, "abc"))))
    f1 = []
    for x in "abc":
        tp = sum(g == c == x for g, c in pairs)
        size = sum(g == x for g, _ in pairs) + sum(c == x for _, c in pairs)
        f1.append(Fraction(2 * tp, size) if size else Fraction(0))
    assert r.macro_f1 == pytest.approx(float(sum(f1) / 3))
    assert r.accuracy == pytest.approx(sum(g == c for g, c in pairs) / len(pairs))

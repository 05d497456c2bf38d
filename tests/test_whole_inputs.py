"""No query or operator leaves part of its input out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, decide, runs, timing
from plumbline.queries import QUERIES


def test_bootstrap_draws_all_resamples(spark, data):
    assert QUERIES["bootstrap_speedup"](spark, data).first().resamples == 2000


def test_bootstrap_refuses_more_processes_than_it_takes(spark, monkeypatch):
    monkeypatch.setattr(compare, "MAX_PROCESSES", 2, raising=False)
    rows = [(system, f"p{i}", "c", 1.0) for system in ("baseline", "candidate") for i in range(3)]
    t = spark.createDataFrame(rows, "system string, run_id string, case_id string, seconds double")
    with pytest.raises(ValueError, match="more than 2 processes"):
        compare.bootstrap_speedup(t, resamples=5)
    assert compare.bootstrap_speedup(t.where("run_id < 'p2'"), resamples=5).first().resamples == 5


def test_best_of_more_candidates_than_a_block(spark):
    states = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 255, 256, 511, 512, 599))], "id long, x double")
    cands = spark.range(600).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("id"), F.col("id").cast("double").alias("v")).repartition(5)
    got = decide.best(states.withColumnRenamed("id", "state"), cands, lambda c: -F.abs(F.col("x") - c["v"]), "state", "v")
    assert {r.state: r.choice for r in got.collect()} == {0: "c0", 1: "c255", 2: "c256", 3: "c511", 4: "c512", 5: "c599"}
    ties = decide.best(states.withColumnRenamed("id", "state"), cands, lambda c: F.lit(1.0), "state")
    assert {r.choice for r in ties.collect()} == {"c0"}


def test_documents_are_held_against_every_item(spark, data):
    whole = {r.doc_id: r for r in QUERIES["lexical_overlap_classify_all"](spark, data).collect()}
    some = {r.doc_id: r for r in QUERIES["lexical_overlap_classify"](spark, data).collect()}
    assert whole.keys() == some.keys()
    assert all(whole[i].score >= some[i].score for i in some)
    assert any(r.choice >= 8 for r in whole.values())


def test_fixed_denominator_counts_all_calls(spark):
    rows = [("a", i, i >= 20, 1, 1.0) for i in range(25)] + [("b", 0, True, 3, 1.0)]
    calls = spark.createDataFrame(rows, "example string, repeat int, correct boolean, tokens int, seconds double")
    got = {r.example: (r.quality, r.tokens_per_second) for r in timing.fixed_denominator(calls).collect()}
    assert got == {"a": (5 / 25, 1.0), "b": (1 / 25, 3.0)}


def test_integrity_sees_attempts_out_of_range(spark, data):
    rows = [("a", i, "x", None, "m", 1.0) for i in (0, 2, 3)]  # of two planned: 1 is missing, 2 and 3 are too many
    a = spark.createDataFrame(rows, "id string, repeat int, choice string, error_type string, model string, seconds double")
    got = {r.violation: r.n for r in runs.integrity(a, a.select("id").distinct(), 2).collect()}
    assert (got["missing_attempt"], got["repeat_out_of_range"]) == (1, 2)
    assert {r.violation: r.n for r in QUERIES["run_integrity_all"](spark, data).collect()}["repeat_out_of_range"] > 0

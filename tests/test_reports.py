"""Reports, the command line, heads, and experiment rules."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.__main__ import main
from plumbline.operators import experiment, heads, runs
from plumbline.report import cell, markdown, rows_of, write_bundle


def test_markdown_cells():
    assert cell("a|b\n c\\") == "a\\|b c\\\\"
    assert cell(None) == "—"
    assert len(cell("x" * 500)) == 240
    assert markdown("t", []).endswith("No rows.\n")


def test_bundle_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1.5)], "run string, value double")
    write_bundle(str(tmp_path / "b"), {"metrics": df})
    assert json.loads((tmp_path / "b" / "report.json").read_text()) == {"metrics": [{"run": "=x", "value": 1.5}]}
    assert "'=x" in next((tmp_path / "b" / "metrics").glob("*.csv")).read_text()
    with pytest.raises(FileExistsError):
        write_bundle(str(tmp_path / "b"), {"metrics": df})
    with pytest.raises(ValueError, match="at most"):
        rows_of(spark.range(11), 10)


def test_command_line(spark, data, capsys, tmp_path):
    assert main(["list"]) == 0
    assert "classification_summary" in capsys.readouterr().out
    assert main(["run", "constant_baseline", data]) == 0
    assert "| choice |" in capsys.readouterr().out
    assert main(["run", "constant_baseline", data, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    with pytest.raises(SystemExit):
        main(["run", "nothing", data])


def test_schemas_parse(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper() and not name.startswith("_") and name not in ("CANDIDATE", "QUESTION", "SHARE"):
            assert spark.createDataFrame([], ddl).columns


def test_heads(spark):
    rng = np.random.default_rng(0)
    layers = [heads.Layer(rng.normal(size=(3, 4)), np.zeros(4), "tanh", normalise=True), heads.Layer(rng.normal(size=(4, 2)), np.ones(2))]
    x = rng.normal(size=(5, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = np.array([r.y for r in df.select("id", heads.head(spark, layers)(F.col("v")).alias("y")).orderBy("id").collect()])
    want = layers[1](layers[0](x))
    assert got == pytest.approx(want / np.linalg.norm(want, axis=1, keepdims=True), abs=1e-9)
    twice = heads.encode_once(df.unionAll(df).withColumn("t", F.col("id").cast("string")), "t", lambda t: F.array(t.cast("double")))
    assert twice.count() == 10


def test_first_attempt_counts_even_if_it_failed(spark):
    a = spark.createDataFrame([("x", 0, None), ("x", 1, "a"), ("y", 0, "b")], "id string, repeat int, choice string")
    assert sorted(tuple(r) for r in runs.first_attempts(a).collect()) == [("x", None, False), ("y", "b", False)]


def test_changed_models_are_found(spark):
    a = spark.createDataFrame([("x", 0, None), ("x", 1, "m"), ("x", 2, "n")], "id string, repeat int, model string")
    assert [(r.repeat, r.model) for r in runs.identity_changes(a).collect()] == [(2, "n")]


def attempt(spark, **more):
    base = {"case_id": "c", "repeat": 0, "query": "q", "system": "s", "output_sha256": "h", "duration_seconds": 1.0}
    return spark.createDataFrame([{**base, **more}], schemas.RAG_ATTEMPT)


def case(spark, **more):
    base = {"case_id": "c", "query": "q", "case_ord": 0, "relevance": {"a": 1, "b": 1}, "evidence_sets": [["a", "b"]], "evidence_texts": {}}
    return spark.createDataFrame([{**base, **more}], schemas.RAG_CASE)


def test_recall_is_split_at_the_reranker(spark):
    r = experiment.assess(case(spark), attempt(spark, retrieval=["a"], reranking=["a"]), 1).collect()[0]
    assert r.retrieval_metrics.known_recall_at_k == 0.5
    assert r.reranking_metrics.known_recall_at_k == 0.5
    assert r.shortlist_reranking.known_recall_at_k == 1.0
    assert r.losses.retrieval_missing == ["b"]
    assert (r.status_retrieval, r.status_context, r.source_coverage_retrieval) == ("observed", "not_observed", False)


def test_failures_and_missing_attempts_stay_unknown(spark):
    cases = case(spark).unionAll(case(spark, case_id="d")).unionAll(case(spark, case_id="e"))
    done = attempt(spark, answer="x", review_correct=True, review_scores={"style": 2.0}).unionAll(attempt(spark, case_id="d", output_sha256=None, error_phase="pipeline"))
    rules = spark.createDataFrame([("answer.correct", 1.0, None, 0.2)], schemas.GATE)
    r = experiment.report(cases, done, rules, 5, 1)
    m = {x.metric: x for x in r["summary"].collect()}
    assert (m["answer.correct"].observed, m["answer.correct"].unknown, m["answer.correct"].coverage) == (1, 2, pytest.approx(1 / 3))
    assert m["custom.style"]["mean"] == 2.0
    assert tuple(r["state"].collect()[0])[:4] == (3, 2, 1, 1)
    assert [x.status for x in r["gates"].collect()] == ["passed"]
    assert tuple(r["verdict"].collect()[0]) == ("incomplete", False)


def test_replays_don_t_count(spark):
    done = attempt(spark, answer="x", review_correct=True, replay=True)
    r = experiment.report(case(spark), done, spark.createDataFrame([], schemas.GATE), 5, 1)
    assert r["summary"].count() == 0
    s = r["state"].collect()[0]
    assert (s.diagnostic, s.eligible) == (1, 0)
    assert r["verdict"].collect()[0].passed is None


def test_reviews_that_contradict_are_found(spark):
    done = attempt(spark, review_correct=True)
    assert experiment.contradictions(case(spark, correct=False), done).count() == 1
    assert experiment.contradictions(case(spark, correct=True), done).count() == 0
    assert len(experiment.review_inputs(case(spark), done).collect()[0].review_input_sha256) == 64

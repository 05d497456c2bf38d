"""Commands that end with a status, and the rules behind small reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.operators import rag
from plumbline.queries.runs import cases_and_attempts
from plumbline.sources.receipts import save_run


@pytest.fixture(scope="module")
def experiment_folder(spark, data, tmp_path_factory):
    place = tmp_path_factory.mktemp("experiment")
    cases, done = cases_and_attempts(spark, data)
    cases.write.parquet(f"{place}/cases")
    done.where("repeat = 0").write.parquet(f"{place}/attempts")
    return place


@pytest.mark.parametrize(
    ("repeats", "gates", "status", "want"),
    [
        (1, None, 0, {"status": "complete", "passed": None}),
        (1, [{"metric": "pipeline.duration_seconds", "maximum": 1, "min_coverage": 1}], 0, {"status": "complete", "passed": True}),
        (1, [{"metric": "pipeline.duration_seconds", "maximum": 0.1}], 1, {"status": "complete", "passed": False}),
        (1, [{"metric": "no.such", "minimum": 0}], 1, {"status": "complete", "passed": False}),
        (2, None, 1, {"status": "incomplete", "passed": None}),
    ],
)
def test_rag_status(spark, experiment_folder, tmp_path, repeats, gates, status, want):
    args = ["rag", str(tmp_path / "report"), f"{experiment_folder}/cases", f"{experiment_folder}/attempts", "--repeats", str(repeats)]
    if gates is not None:
        (tmp_path / "gates.json").write_text(json.dumps(gates))
        args += ["--gates", str(tmp_path / "gates.json")]
    assert main(args) == status
    report = json.loads((tmp_path / "report" / "report.json").read_text())
    assert report["verdict"] == [want]
    assert {"summary", "gates", "state"} <= set(report) and "## summary" in (tmp_path / "report" / "report.md").read_text()
    with pytest.raises(FileExistsError):
        main(args)


def test_verify_status(spark, tmp_path, capsys):
    save_run(spark.range(100).repartition(2), str(tmp_path / "run"))
    assert main(["verify", str(tmp_path / "run")]) == 0
    assert "100 rows" in capsys.readouterr().out
    part = next((tmp_path / "run").glob("part-*.jsonl"))
    part.write_bytes(part.read_bytes().replace(b"7", b"8", 1))
    assert main(["verify", str(tmp_path / "run")]) == 1
    assert main(["verify", str(tmp_path / "nothing")]) == 1


def test_fixture_review(spark):
    rows = [("Yes.", "Yes.", "So: Yes."), ("yes", "Yes.", "yes"), ("", "", "x"), (None, "a", "a"), ("a", "a", None), (" a \t b ", "a", "a")]
    df = spark.createDataFrame(rows, "a string, e string, c string").select(rag.fixture_review(F.col("a"), F.col("e"), F.col("c")).alias("r"))
    got = [None if r.r is None else (r.r.correct, r.r.grounded, r.r.answer_words) for r in df.collect()]
    assert got == [(True, True, 1.0), (False, True, 1.0), (True, False, 0.0), None, None, (False, False, 2.0)]


def test_starter_rule(spark):
    rows = [("good", False, True), ("good", False, True), ("wrong", False, True), ("wrong", False, False), ("failed", False, True), ("failed", True, True), ("unknown", False, None)]
    got = {r.d: (r.cases, r.failed, r["mean"], r.passed) for r in rag.starter_rule(spark.createDataFrame(rows, "d string, f boolean, m boolean"), "d", "f", "m").collect()}
    assert got == {"good": (2, 0, 1.0, True), "wrong": (2, 0, 0.5, False), "failed": (2, 1, 0.5, False), "unknown": (1, 0, 0.0, False)}

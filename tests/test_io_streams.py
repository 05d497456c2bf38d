"""Sources, sinks and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import io
from plumbline.streaming.pipeline import classify_stream, evaluate, stream_files


def test_json_documents_see_repeated_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "n": 1}')
    (tmp_path / "b.json").write_text('{"name": "x", "name": "y"}')
    r = {x.file[-6:]: x.valid for x in io.json_documents(spark, str(tmp_path), "name string, n int").collect()}
    assert r == {"a.json": True, "b.json": False}


def test_json_lines_fail_on_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert io.json_lines(spark, str(tmp_path), "id string").count() == 2
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n{"id": "2", "id": "3"}\n')
    with pytest.raises(Exception, match="repeated key"):
        io.json_lines(spark, str(tmp_path), "id string").collect()


def test_strict_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('text,category\n"a ""b""\nc",k\nd,l\n')
    df = io.strict_csv(spark, str(tmp_path / "x.csv"), "text string, category string", rows=2)
    assert [r.text for r in df.collect()] == ['a "b"\nc', "d"]
    with pytest.raises(io.SourceError):
        io.strict_csv(spark, str(tmp_path / "x.csv"), "text string, category string", rows=3)
    with pytest.raises(Exception):  # noqa: B017  another header
        io.strict_csv(spark, str(tmp_path / "x.csv"), "text string, other string").collect()


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1)], "name string, n int")
    io.new_csv(df, str(tmp_path / "out"))
    assert "'=1+1" in next((tmp_path / "out").glob("*.csv")).read_text()
    with pytest.raises(Exception, match="exist"):
        io.new_csv(df, str(tmp_path / "out"))


def test_hashes_and_history(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "report.json").write_text(json.dumps({"run": n, "accuracy": 0.5}))
    assert io.history(spark, str(tmp_path), "run string, accuracy double").count() == 2
    files = io.verified_files(spark, str(tmp_path))
    assert files.count() == 2
    assert len(io.tree_hash(files).collect()[0][0]) == 64


def test_attach_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert sorted(tuple(r) for r in io.attach(left, spark.createDataFrame([(1, "r")], "k int, review string"), ["k"]).collect()) == [(1, "a", "r"), (2, "b", None)]
    with pytest.raises(Exception, match="repeated"):
        io.attach(left, spark.createDataFrame([(1, "r"), (1, "s")], "k int, review string"), ["k"]).collect()


def test_errors_are_data(spark):
    def judge(t: str) -> str:
        return str(1 // (len(t) - 1))

    r = {x.id: (x.choice, x.error_type) for x in evaluate(spark.createDataFrame([(1, "abc"), (2, "a")], "id int, text string"), judge, "text", "id", workers=2).collect()}
    assert r == {1: ("0", None), 2: (None, "ZeroDivisionError")}


def test_stream_resumes_without_repeats(spark, tmp_path):
    schema = "id int, text string"
    judge = lambda df: df.select("id", F.length("text").alias("n"))
    for batch in range(2):
        spark.createDataFrame([(batch, "x" * (batch + 1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        classify_stream(stream_files(spark, str(tmp_path / "in"), schema, 1), judge, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1), (1, 2)]

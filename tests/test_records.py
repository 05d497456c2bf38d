"""Sources, prefixes, receipts and bounds of the record queries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import decide, prepare, rag
from plumbline.operators.running import running
from plumbline.sources import io


def test_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\r\n')
    rows = io.json_lines(spark, str(tmp_path / "a.jsonl"), "id string", numbered=True).collect()
    assert [(r.line, r.id) for r in rows] == [(1, "x"), (3, "y")]
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n{"id": "y", "id": "z"}\n')
    with pytest.raises(Exception, match="line 2"):
        io.json_lines(spark, str(tmp_path / "b.jsonl"), "id string", numbered=True).collect()


def test_labelled_cases(spark, tmp_path):
    rows = [{"id": "a", "split": "dev"}, {"id": "a", "split": "test"}, {"id": "b", "split": "test"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert io.labelled_cases(spark, str(tmp_path / "c.jsonl"), "id string, split string", "test").count() == 2
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, [*rows, rows[1]])))
    with pytest.raises(io.SourceError, match="repeated ids"):
        io.labelled_cases(spark, str(tmp_path / "d.jsonl"), "id string, split string", "test")


def test_csv_with_notes(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes("\ufefftext,label,\r\n\"a, b\",x,note\r\nc,y,\r\n".encode())
    rows = io.csv_with_notes(spark, str(tmp_path / "n.csv"), "text string, label string").collect()
    assert [tuple(r) for r in rows] == [("a, b", "x"), ("c", "y")]
    (tmp_path / "m.csv").write_text("text,label\na,x\n")
    assert io.csv_with_notes(spark, str(tmp_path / "m.csv"), "text string, label string").count() == 1
    with pytest.raises(io.SourceError, match="other columns"):
        io.csv_with_notes(spark, str(tmp_path / "m.csv"), "text string, kind string")
    ids = io.split_csv(spark, str(tmp_path / "m.csv"), "text string, label string", "train", 1)
    assert [tuple(r) for r in ids.collect()] == [("train:0", "train", "a", "x")]


def test_case_datasets(spark):
    choice, ranking = io.case_datasets(spark.createDataFrame([("choice", 1), ("ranking", 2), ("choice", 3)], "kind string, n int"))
    assert (choice.count(), ranking.count(), choice.columns) == (2, 1, ["n"])
    with pytest.raises(Exception, match="kind choice or ranking"):
        io.case_datasets(spark.createDataFrame([("other", 1)], "kind string, n int"))[0].collect()


def test_a_prefix_must_be_there(spark):
    assert [r.id for r in io.source_prefix(spark.range(9, 0, -1), "id", 3).collect()] == [1, 2, 3]
    with pytest.raises(io.SourceError, match="10 rows are asked for"):
        io.source_prefix(spark.range(9), "id", 10)


def test_sinks_have_no_part_of_a_header_only(spark, tmp_path):
    io.new_csv(spark.createDataFrame([("a", 1)], "name string, n int").repartition(7), str(tmp_path / "out"))
    assert [f.read_text() for f in (tmp_path / "out").glob("*.csv")] == ["name,n\na,1\n"]


def test_candidates_over_the_bound_are_an_error(spark):
    many = spark.range(257).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit(1).alias("x"))
    assert decide.candidate_rows(many.where("ord < 256"), "x").count() == 256
    with pytest.raises(Exception, match="1 to 256 candidates"):
        decide.candidate_rows(many, "x").collect()
    with pytest.raises(Exception, match="1 to 256 candidates"):
        decide.permitted(spark.createDataFrame([(1,)], "k int"), many, spark.createDataFrame([(1, "3")], "k int, id string"), "k").collect()


def test_an_unresolved_ticket_is_not_compiled(spark):
    tickets = spark.createDataFrame([(1, "dev", "t")], "id int, split string, text string")
    with pytest.raises(Exception, match="not resolved"):
        prepare.compile_splits(tickets, spark.createDataFrame([(1, None, "unresolved")], "id int, label string, how string")).collect()


@pytest.mark.parametrize("blocks", [1, 3, 600])
def test_running_totals_in_any_number_of_stretches(spark, blocks):
    rows = spark.range(2000).select(((F.col("id") * 7) % 2000).alias("o"), F.lit(1).alias("one"))
    got = running(rows, "o", {"one": "seq"}, blocks=blocks).collect()
    assert all(r.seq == r.o + 1 for r in got)
    back = running(rows, "o", {"one": "seq"}, descending=True, blocks=blocks).collect()
    assert all(r.seq == 2000 - r.o for r in back)


def test_a_mean_of_extremes_is_finite(spark):
    values = spark.createDataFrame([("m", 1.7e308), ("m", 1.7e308), ("m", -1.7e308)], "metric string, value double")
    mean = rag.metric_summary(values, spark.createDataFrame([(3,)], "eligible int")).first()["mean"]
    assert mean == pytest.approx(1.7e308 / 3)

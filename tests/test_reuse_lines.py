"""Vectors by content, never poisoned by a failed encoding; line numbers of files in many splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import reuse
from plumbline.operators.reuse import EncodingError, VectorStore
from plumbline.sources.io import json_lines, numbered_lines

MODEL = {"name": "m", "revision": "1"}


def asked(spark, rows, model=MODEL):
    return reuse.keyed(spark.createDataFrame(rows, "id long, tokens array<int>"), model, "tokens")


def length_and_sum(t):
    return F.array(F.size(t).cast("double"), F.aggregate(t, F.lit(0), lambda a, x: a + x).cast("double"))


def test_tokens_and_model_are_bound(spark):
    rows = [(1, [1, 23]), (2, [12, 3]), (3, [1, 23]), (4, []), (5, None), (6, [1, None]), (7, [-1])]
    keys = [r.key for r in asked(spark, rows).orderBy("id").collect()]
    assert keys[0] == keys[2] != keys[1] and keys[3:] == [None] * 4
    others = [{"name": "m", "revision": "2"}, {"name": "m1", "revision": ""}, {"name": "m"}]
    assert len({asked(spark, rows[:1], m).first().key for m in [MODEL, *others]}) == 4


def test_each_row_of_tokens_is_encoded_once(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", 2)
    a = asked(spark, [(1, [1, 2]), (2, [3]), (3, [1, 2]), (4, [])])
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(t):
        calls.add(1)
        return [float(len(t)), float(sum(t))]

    assert tuple(reuse.reuse_plan(store.read(), a).first()) == (4, 1, 2, 0, 2)
    assert store.fill(a, "tokens", counted) == 2 and calls.value == 2
    b = asked(spark, [(1, [1, 2]), (5, [9])])
    assert tuple(reuse.reuse_plan(store.read(), b).first()) == (2, 0, 2, 1, 1)
    assert store.fill(b, "tokens", counted) == 1 and calls.value == 3
    assert store.fill(b, "tokens", counted) == 0 and calls.value == 3
    assert {r.id: r.vector for r in store.look_up(a).collect()} == {1: [2.0, 3.0], 2: [1.0, 3.0], 3: [2.0, 3.0], 4: None}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_a_failed_encoding_keeps_nothing(spark, tmp_path, bad):
    store = VectorStore(spark, f"file://{tmp_path}/store", 2)
    store.fill(asked(spark, [(1, [1])]), "tokens", length_and_sum)
    b = asked(spark, [(2, [2]), (3, [3, 3])])
    broken = lambda t: F.when(F.size(t) == 1, length_and_sum(t)).otherwise(F.array(F.lit(1.0), F.lit(bad).cast("double")))
    with pytest.raises(EncodingError, match="1 of 2"):
        store.fill(b, "tokens", broken)
    assert store.read().count() == 1
    with pytest.raises(EncodingError, match="2 of 2"):
        store.fill(b, "tokens", lambda t: F.array(F.lit(1.0)))
    assert store.fill(b, "tokens", length_and_sum) == 2
    assert {r.id: r.vector for r in store.look_up(b).collect()} == {2: [1.0, 2.0], 3: [2.0, 6.0]}


def test_lines_of_files_in_many_splits(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        for name, n in (("a", 3000), ("b", 500), ("c", 1)):
            (tmp_path / f"{name}.jsonl").write_text("".join("\n" if i % 7 == 6 else f'{{"id": {i + 1}, "t": "{"x" * (i % 90)}"}}\n' for i in range(n)))
        got = numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 20
        rows = json_lines(spark, str(tmp_path), "id long, t string", numbered=True).collect()
        assert len(rows) == sum(1 for n in (3000, 500, 1) for i in range(n) if i % 7 != 6)
        assert all(r.line == r.id for r in rows)
        with open(tmp_path / "a.jsonl", "a") as f:
            f.write('{"id": 1, "id": 2}\n')
        with pytest.raises(Exception, match=r"a\.jsonl line 3001"):
            json_lines(spark, str(tmp_path), "id long, t string", numbered=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

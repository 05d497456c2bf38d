"""Replays recompute what lies downstream and are never counted; a stream keeps its state over a restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import experiment, replay
from plumbline.operators.replay import Rule
from plumbline.queries.runs import cases_and_attempts
from plumbline.streaming.identity import run_checked

SCHEMA = "id long, retrieval array<string>, reranking array<string>, context array<string>, context_text string, answer string, judged boolean, replay boolean"
RECORDED = ["retrieval", "reranking", "context", "context_text", "answer", "judged"]


def rules():
    text = lambda: F.array_join("context", " ")
    return [
        Rule("answer", ("context_text",), lambda: F.when(F.contains("context_text", F.lit("invoice")), "found").otherwise("not found")),
        Rule("context_text", ("context",), text),
        Rule("context", ("reranking",), lambda: F.slice("reranking", 1, 1)),
        Rule("reranking", ("retrieval",), lambda: F.reverse("retrieval")),
        Rule("judged", ("answer",)),
    ]


@pytest.fixture
def traces(spark):
    return spark.createDataFrame([(1, ["profile", "invoice"], ["profile", "invoice"], ["profile"], "profile", "not found", True, None), (2, ["x"], ["x"], ["x"], "x", "not found", None, None)], SCHEMA)


def test_only_downstream_is_made_again(traces):
    r = {x.id: x for x in replay.replay(traces, "context", F.slice("reranking", 1, 2), rules(), RECORDED, "two passages").collect()}
    assert (r[1].reranking, r[1].context, r[1].context_text, r[1].answer, r[1].judged) == (["profile", "invoice"], ["profile", "invoice"], "profile invoice", "found", None)
    assert r[1].replay is True and r[1].replay_.changed_boundary == "context" and r[1].replay_.recomputed == ["context_text", "answer"] and r[1].replay_.unknown == ["judged"]
    out = replay.replay(traces, "retrieval", F.array(F.lit("invoice"), F.lit("y")), rules(), RECORDED, "other passages")
    assert {(x.id, x.answer, *x.context) for x in out.collect()} == {(1, "not found", "y"), (2, "not found", "y")}
    late = replay.replay(traces, "answer", F.lit("found"), rules(), RECORDED, "another answer").first()
    assert late.context == ["profile"] and late.judged is None


def test_effects_and_binding(traces):
    r = replay.replay(traces, "context", F.slice("reranking", 1, 2), rules(), RECORDED, "two passages")
    got = {x.id: (x.bound, x.changed) for x in replay.effects(traces, r, ["id"], RECORDED).collect()}
    assert got == {1: (True, ["context", "context_text", "answer"]), 2: (True, [])}
    other = traces.withColumn("answer", F.lit("changed since"))
    assert not any(x.bound for x in replay.effects(other, r, ["id"], RECORDED).collect())


def test_rules_in_a_circle(traces):
    with pytest.raises(ValueError, match="depend on each other"):
        replay.replay(traces, "retrieval", F.array(), [Rule("context", ("answer", "retrieval"), lambda: F.array()), Rule("answer", ("context",), lambda: F.lit(""))], RECORDED, "x")
    with pytest.raises(ValueError, match="isn't recorded"):
        replay.replay(traces, "routing", F.lit(1), rules(), RECORDED, "x")


def test_replays_are_never_eligible(spark, data):
    cases, done = cases_and_attempts(spark, data)
    again = replay.replay(done.where("repeat = 1"), "context", F.slice("reranking", 1, 3), [Rule("answer", ("context",), lambda: F.lit("b"))], ["context", "answer"], "three").drop("replay_")
    both = done.where("repeat = 0").unionByName(again)
    state = experiment.state(cases, experiment.assess(cases, both, 5), 2).first()
    assert state.diagnostic == again.count() and state.eligible == state.planned - state.diagnostic
    values = experiment.values(experiment.assess(cases, both, 5))
    assert values.where("repeat = 1").count() == 0 and values.where("repeat = 0").count() > 0


STREAM = "example bigint, repeat bigint, model string, choice string, error_type string"


def add(spark, place, rows):
    spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(f"{place}/in")


def run(spark, place):
    source = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    run_checked(source, f"{place}/out", f"{place}/state").awaitTermination()
    return sorted((r.example, r.repeat, r.choice, r.error_type, r.failures) for r in spark.read.parquet(f"{place}/out").collect())


def test_a_restarted_stream_skips_what_is_done(spark, tmp_path):
    first = [(1, 0, "m1", "a", None), (1, 1, "m2", "a", None), (2, 0, "m2", None, "Timeout"), (2, 1, "m2", "b", None)]
    add(spark, tmp_path, first)
    got = run(spark, tmp_path)
    assert got == [(1, 0, "a", None, 0), (1, 1, None, "ModelChanged", 1), (2, 0, None, "Timeout", 1), (2, 1, "b", None, 1)]
    # the source delivers all again, and more: the first models, what was seen and the failures are still known
    add(spark, tmp_path, [*first, (1, 2, "m1", "c", None), (2, 2, "m1", "b", None), (3, 0, "m9", "z", None)])
    assert run(spark, tmp_path) == sorted([*got, (1, 2, "c", None, 1), (2, 2, None, "ModelChanged", 2), (3, 0, "z", None, 0)])
    assert len(run(spark, tmp_path)) == 7  # nothing new


def test_state_grows_by_bundles_and_blocks(spark, tmp_path):
    """An entry for each attempt cost a call or two for each attempt."""
    add(spark, tmp_path, [(e, r, "m1", "a", None) for e in range(64) for r in range(50)])
    source = spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in")
    query = run_checked(source, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 64 * 50
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) <= 20  # two bundles of examples


def test_repeats_and_examples_at_the_edges_of_blocks_and_bundles(spark, tmp_path):
    """Each example's own first model, repeats and failures, whichever others share its entries; null, negative and large ids too."""
    examples = [None, -33, -32, -1, 0, 31, 32, 2**60, 2**60 + 1]
    models = {e: f"m{i}" for i, e in enumerate(examples)}
    first = [(e, r, models[e], "a", None) for e in examples for r in (1024, 0, 1023, 7_000_000_000)]
    later = [(e, r, "other", "a", None) for e in examples for r in (1, 1025)]
    add(spark, tmp_path, first)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])

    def now():
        source = spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in")
        run_checked(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("example", "repeat", "model", "choice", "error_type", "failures").collect()), key=key)

    done = [(*r, 0) for r in first]
    assert now() == sorted(done, key=key)
    add(spark, tmp_path, [*later, *first, *later])
    done += [(e, r, m, None, "ModelChanged", 1 if r == 1 else 2) for e, r, m, _, _ in later]
    assert now() == sorted(done, key=key)
    add(spark, tmp_path, first)
    assert now() == sorted(done, key=key)  # nothing new in any bundle


def test_a_bundle_of_many_rows_is_given_out_in_parts(spark, tmp_path):
    rows = [(e, r, "m1" if r else "m0", "a", None) for e in (1, 2) for r in range(9_000)]
    add(spark, tmp_path, rows)
    run_checked(spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.example, r.repeat, r.failures) for r in got) == [(e, r, r) for e, r, *_ in rows]

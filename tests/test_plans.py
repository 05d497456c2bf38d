"""Physical plans: what must, and must not, be in them."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

from plumbline.operators import decide
from plumbline.plans.fixtures import predictions, scored, table
from plumbline.queries import QUERIES


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scoring_shuffles_no_states(spark, data):
    p = plan(scored(spark, data))
    assert "BroadcastNestedLoopJoin" in p
    assert "SortMergeJoin" not in p
    assert "CartesianProduct" not in p


def test_columns_are_pruned(spark, data):
    p = plan(QUERIES["latency_cv"](spark, data))
    assert "props" not in p.split("ReadSchema")[1].splitlines()[0]
    assert "text" not in plan(QUERIES["constant_baseline"](spark, data)).split("ReadSchema")[1].splitlines()[0]


def test_filters_reach_the_scan(spark, data):
    p = plan(table(spark, data, "events").where("event_type = 'click'").select("value"))
    assert "EqualTo(event_type,click)" in p


@pytest.mark.parametrize("name", ["classification_summary", "reliability_bins", "routing_rates", "oos_auroc_ap_fpr95", "ir_metrics_graded", "dup_between_splits", "paired_outcomes", "latency_distribution"])
def test_metrics_stay_in_the_jvm(spark, data, name):
    p = plan(QUERIES[name](spark, data))
    assert "Python" not in p
    assert "Pandas" not in p
    assert "CartesianProduct" not in p


@pytest.mark.parametrize(
    ("name", "scans", "exchanges"),
    [("classification_summary", 3, 8), ("benchmark_deltas", 3, 8), ("confusion_matrix", 3, 6), ("choice_scores", 2, 3), ("lexical_retrieval_topn", 2, 4), ("dup_between_splits", 3, 6)],
)
def test_scans_and_exchanges(spark, data, name, scans, exchanges):
    """As planned, before adaptive execution reuses any of them."""
    tree = plan(QUERIES[name](spark, data)).split("\n\n")[0]
    assert tree.count("Scan parquet") <= scans
    assert tree.count("Exchange (") - tree.count("BroadcastExchange (") <= exchanges


def test_no_text_is_dealt_by(spark, data):
    for name in ("dup_within_split", "dup_between_splits", "train_overlap_semi", "dedup_encode_plan", "support_audit_findings"):
        keys = [x for x in plan(QUERIES[name](spark, data)).splitlines() if x.startswith("Arguments: hashpartitioning(")]
        assert keys
        assert not any(f"hashpartitioning({k}" in x for x in keys for k in ("text", "lower(", "regexp"))


def test_top_n_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(QUERIES["split_per_label_sha10"](spark, data))


def test_rows_don_t_depend_on_partitioning(spark, data):
    a = predictions(spark, data).select("vec_id", "choice").orderBy("vec_id").collect()
    b = predictions(spark, data).repartition(7).select("vec_id", "choice").orderBy("vec_id").collect()
    assert a == b
    assert decide.MAX_CANDIDATES == 256

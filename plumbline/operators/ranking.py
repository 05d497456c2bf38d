"""Ranking metrics with three-valued logic: an unjudged or unseen document is unknown, not irrelevant.

A row holds a ranking (array of ids) and its judgments (map from id to grade; 0: judged irrelevant). All
metrics are expressions over these, so a table of queries is assessed without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import let, total


def _discounted(grades: Column, top: Column) -> Column:
    return let(top, lambda t: total(F.transform(grades, lambda g, i: (g / t) / F.log2(i.cast("double") + 2))))


def assess(ranked: Column, judgments: Column, k: int, complete: Column | bool = True) -> dict[str, Column]:
    """top1, hit_at_k, known_recall_at_k, reciprocal_rank, ndcg_at_k, judged_fraction_at_k, unjudged_ids.

    complete: false if the ranking is a recorded prefix whose tail wasn't observed. Recall is over the
    known positives, also those never returned. Gains are linear, scaled by the largest grade.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    complete = F.lit(complete) if isinstance(complete, bool) else complete
    grades = F.transform(ranked, lambda i: F.try_element_at(judgments, i).cast("double"))
    n = F.size(ranked)
    prefix = F.slice(grades, 1, k)
    seen = complete | (F.lit(k) <= n)
    unknown = F.exists(prefix, lambda g: g.isNull())
    judged_any = F.size(judgments) > 0
    ideal = F.slice(F.sort_array(F.transform(F.filter(F.map_values(judgments), lambda g: g > 0), lambda g: g.cast("double")), asc=False), 1, k)
    positives = F.size(F.filter(F.map_values(judgments), lambda g: g > 0))
    hits = F.size(F.filter(prefix, lambda g: F.coalesce(g > 0, F.lit(False))))
    first = F.array_position(F.transform(grades, lambda g: F.coalesce(g > 0, F.lit(False))), True)
    before = F.slice(grades, F.lit(1), F.greatest(first, F.lit(1)).cast("int"))
    top_grade = F.get(grades, F.lit(0))
    top = F.get(ideal, F.lit(0))
    unjudged = F.filter(ranked, lambda i: ~F.map_contains_key(judgments, i))
    return {
        "top1": F.when((n > 0) & top_grade.isNotNull(), (top_grade > 0).cast("double")).when((n == 0) & (positives > 0) & complete, F.lit(0.0)),
        "hit_at_k": F.when(hits > 0, F.lit(1.0)).when(seen & ~unknown & judged_any, F.lit(0.0)),
        "known_recall_at_k": F.when((positives > 0) & (seen | (hits == positives)), hits / F.nullif(positives, F.lit(0))),
        "reciprocal_rank": F.when(first > 0, F.when(~F.exists(before, lambda g: g.isNull()), 1 / F.nullif(first, F.lit(0).cast("long")))).when(
            (positives > 0) & (F.size(unjudged) == 0) & complete, F.lit(0.0)
        ),
        "ndcg_at_k": F.when((positives > 0) & seen & ~unknown, _discounted(prefix, top) / _discounted(ideal, top)),
        "judged_fraction_at_k": F.when((n > 0) & seen, F.size(F.filter(prefix, lambda g: g.isNotNull())) / F.nullif(F.size(prefix), F.lit(0))),
        "unjudged_ids": unjudged,
    }


REASONS = {
    "top1": "first result is unjudged, or no first result was judged",
    "hit_at_k": "no known hit, and the prefix isn't fully observed and judged",
    "known_recall_at_k": "no known positives, or unseen places may hold more",
    "reciprocal_rank": "the first relevant place is unknown",
    "ndcg_at_k": "needs positives and a fully observed, fully judged prefix",
    "judged_fraction_at_k": "no results, or the prefix isn't fully observed",
}


def reasons(metrics: dict[str, Column]) -> Column:
    """Why metrics are unknown: a map of those that are."""
    every = F.create_map(*[x for name, why in REASONS.items() for x in (F.lit(name), F.when(metrics[name].isNull(), F.lit(why)))])
    return F.map_filter(every, lambda _, why: why.isNotNull())


def closed_world(ranked: Column, relevant: Column, k: int) -> dict[str, Column]:
    """top1, hit_at_k, recall_at_k, mrr where every id that isn't relevant is irrelevant."""
    ids = F.array_union(ranked, relevant)
    judged = F.map_from_arrays(ids, F.transform(ids, lambda i: F.array_contains(relevant, i).cast("int")))
    m = assess(ranked, judged, k)
    return {"top1": m["top1"], "hit_at_k": m["hit_at_k"], "recall_at_k": m["known_recall_at_k"], "mrr": m["reciprocal_rank"]}

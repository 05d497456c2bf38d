"""Pruned retrieval and word overlap against counting all pairs, and how many pairs are scored."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import decide, overlap
from plumbline.operators.rag import lexical_retrieval

COMMON = [f"c{i}" for i in range(8)]


def corpus(seed, n):
    """Rows of common words and some of many rare ones; keys in no order."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.sample(COMMON, rng.randint(0, 8)) + [f"r{int(rng.paretovariate(0.4)) % 400}" for _ in range(rng.randint(0, 12))]
        rows.append((i * 7919 % 10_007, list(dict.fromkeys(words))))
    return rows


def asked(seed, n):
    rng = random.Random(seed)
    return [(i, list(dict.fromkeys(rng.sample(COMMON, rng.randint(0, 6)) + [f"r{rng.randrange(60)}" for _ in range(rng.randint(0, 8))]))) for i in range(n)]


def frames(spark, rows, asks):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>"), spark.createDataFrame(asks, "query_id long, tokens array<string>")


@pytest.mark.parametrize(("seed", "n", "top", "seeds"), [(1, 300, 5, 256), (2, 300, 5, 3), (3, 40, 50, 2), (4, 300, 1, 1), (5, 0, 3, 4)])
def test_best_rows(spark, seed, n, top, seeds):
    rows, asks = [*corpus(seed, n), (20_000, []), (20_001, None)], [*asked(seed, 25), (90, []), (91, None), (92, ["nowhere"])]
    want = {}
    for q, words in asks:
        scored = sorted((-len(set(words or []) & set(t or [])), doc) for doc, t in rows)
        want[q] = [(doc, -s) for s, doc in scored if s < 0][:top]
    docs, queries = frames(spark, rows, asks)
    got = {q: [] for q, _ in asks}
    for r in overlap.top_rows(docs.repartition(3), "doc_id", "tokens", overlap.stated(queries, "query_id", "tokens"), top, seeds).orderBy("ask", "rank").collect():
        got[r["ask"]].append((r["key"], r["overlap"]))
    assert got == want


@pytest.mark.parametrize(("seed", "most"), [(1, overlap.MOST_TOKENS), (2, 5)])
def test_best_candidate(spark, seed, most):
    """Over the bound of an index too, by a shuffle."""
    rows, asks = [*corpus(seed, 200), (20_000, []), (20_001, None)], [(i + 3, t) for i, t in asked(seed + 9, 40)]
    want = {}
    for doc, t in rows:
        n, o = max((len(set(t or []) & set(words)), -i) for i, words in asks)
        want[doc] = (-o, float(n))
    docs, cands = frames(spark, rows, asks)
    states, cands = docs.withColumnRenamed("tokens", "t"), cands.withColumnsRenamed({"tokens": "t", "query_id": "ord"})
    assert {r["doc_id"]: (r["choice"], r["score"]) for r in decide.most_shared(states, cands, "doc_id", most).collect()} == want


def test_scored_pairs_follow_the_results(spark):
    """All rows share common words with all asks; a fixed number of copies of each ask are found. Twice the rows, as many pairs."""
    asks = [(i, [*COMMON[:5], *(f"a{i}_{k}" for k in range(6))]) for i in range(30)]
    counts, all_pairs = [], []
    for n in (400, 800):
        rng = random.Random(n)
        rows = [(i, [*rng.sample(COMMON, 4), f"x{i}"]) for i in range(1000, 1000 + n)] + [(5000 + 5 * q + k, words) for q, words in asks for k in range(5)]
        docs, queries = frames(spark, rows, asks)
        stated = overlap.stated(queries, "query_id", "tokens")
        assert overlap.top_rows(docs, "doc_id", "tokens", stated, 5, seeds=16).count() == 150
        counts.append(overlap.pairs_of_top_rows(docs, "doc_id", "tokens", stated, 5, seeds=16).count())
        pairs, _ = overlap.pairs_of_best_ask(docs.where("doc_id >= 5000"), "doc_id", "tokens", stated)
        assert pairs.count() < 300  # of 4,500
        all_pairs.append(sum(bool(set(t) & set(words)) for _, t in rows for _, words in asks))
    assert counts == [150, 150]
    assert all_pairs[1] > 1.5 * all_pairs[0] > 10_000


def test_most_pairs_of_the_test_tables_are_never_scored(spark, data):
    from pyspark.sql import functions as F

    from plumbline.functions.text import token_set
    from plumbline.plans.fixtures import table

    docs = table(spark, data, "documents").select("doc_id", token_set(F.col("text")).alias("tokens"))
    items = table(spark, data, "benchmark").select(F.col("item_id").alias("query_id"), token_set(F.col("text")).alias("tokens"))
    stated = overlap.stated(items, "query_id", "tokens")
    scored = overlap.pairs_of_top_rows(docs, "doc_id", "tokens", stated, 10).count()
    sharing = docs.select("doc_id", F.explode("tokens").alias("t")).join(items.select("query_id", F.explode("tokens").alias("t")), "t").select("doc_id", "query_id").distinct().count()
    assert scored < sharing / 5


def test_bounds_are_checked(spark):
    docs, queries = frames(spark, [(1, ["a"])], [(i, ["a", "b"]) for i in range(4)])
    with pytest.raises(ValueError, match="4 queries"):
        lexical_retrieval(docs, queries, 3, most=3)
    assert overlap.stated(queries, "query_id", "tokens", most=7) is None

"""Near copies by shingles against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from plumbline.llm.near_copies import keep_dissimilar

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def survivors(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(up, 2):
        both = len(sets[a] & sets[b])
        if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i for i in up if root(i) == i}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def changed(seed, words, n):
    rng = random.Random(seed)
    out = words[:]
    for i in rng.sample(range(len(out)), n):
        out[i] = f"changed{seed}n{i}"
    return " ".join(out)


def test_near_stage_leaves_no_similar_pair(spark, data):
    """Copies with up to six of 300 words changed, on both sides of the threshold."""
    texts = [t for k in range(12) for base in [prose(100 + k, 300).split()] for t in [" ".join(base), *(changed(10 * k + n, base, n) for n in range(1, 7))]]
    texts += ["", " \n", None, "one two", "One  TWO", "one two three"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    near = dict(corpus_pipeline.STAGES)["near"]
    got = near(spark, docs, data)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == survivors(rows)


def test_rows_that_no_decision_names_stay(spark, corpus, none):
    assert keep_dissimilar(none).count() == 0
    out = keep_dissimilar(corpus).collect()
    assert sum(r.doc_id is None for r in out) == 1
    assert {r.doc_id for r in out if r.doc_id is not None} == survivors([(r.doc_id, r.text) for r in corpus.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None])

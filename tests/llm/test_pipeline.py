"""The corpus pipeline against plain Python, and the registered queries."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F
from test_models import plain_scores, plain_weights
from test_near_copies import survivors

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm.common import Written, table  # noqa: E402
from plumbline.llm.quality import Settings, crc_held_out  # noqa: E402
from plumbline.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mixture", "tokens"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    order = [r.id for r in spark.createDataFrame([(i,) for i in labels], "id long").orderBy(F.xxhash64(F.lit(1), "id")).collect() if not crc_held_out(r.id)]
    plain = plain_scores([(texts[i] or "", labels[i]) for i in order], [t or "" for t in texts.values()], Settings())
    close = {i for i, x in zip(texts, plain, strict=True) if abs(x - 0.7) < 1e-4}  # where single precision may decide
    accepted = {i for i, x in zip(texts, plain, strict=True) if x >= 0.7}

    good = Written(stages["quality"](spark, docs, data), "t").read()
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    assert kept - close == accepted - close
    accepted = kept

    once = Written(stages["exact"](spark, good, data), "t").read()
    first = {}
    for i in sorted(accepted):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    assert {r.doc_id for r in once.collect()} == set(first.values())

    far = Written(stages["near"](spark, once, data), "t").read()
    assert {r.doc_id for r in far.collect()} == survivors([(r.doc_id, r.text) for r in once.collect()])  # all pairs of five-word shingle sets

    mixed = Written(stages["mixture"](spark, far, data), "t").read()
    assert mixed.columns == columns
    visits = collections.Counter(r.doc_id for r in mixed.collect())
    tokens = collections.Counter()
    for r in far.collect():
        tokens[r.source] += len((r.text or "").encode().split())
    weights, budget = plain_weights(tokens), sum(tokens.values())
    used, most = collections.Counter(), collections.Counter()
    for r in far.collect():
        n = len((r.text or "").encode().split())
        used[r.source] += visits[r.doc_id] * n
        most[r.source] = max(most[r.source], n)
    for source, share in weights.items():  # a source has its budget, less than its next document
        assert share * budget - most[source] - 1 <= used[source] <= share * budget + 1

    pieces = stages["tokens"](spark, mixed, data).collect()
    assert sorted(r.doc_id for r in pieces) == sorted(r.doc_id for r in mixed.collect())
    assert all(r.lossless for r in pieces)
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.pieces) for r in whole) == sorted((r.doc_id, r.pieces) for r in pieces)


def test_rows_without_ids_pass(spark, data, corpus):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, corpus, data)
        assert out.columns == corpus.columns, name
        assert out.count() > 0


@pytest.mark.parametrize("empty", [("documents",), ("documents", "labels")])
def test_empty_tables_through_the_pipeline(spark, data, tmp_path, empty):
    for name in ("documents", "labels"):
        some = table(spark, data, name)
        (some.limit(0) if name in empty else some).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "pieces" in out.columns


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query_has_a_row_for_every_row(spark, data, name):
    n = LLM_QUERIES[name](spark, data).count()
    rows = {"op3": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name.startswith("op7"):
        assert n == 50
    elif name.startswith("op11"):
        assert n == 4 * table(spark, data, "embeddings").count()
    elif name.startswith("op12"):
        assert n >= table(spark, data, rows).count()
    elif name.startswith("op13"):
        assert n == table(spark, data, "conversations").select("conv_id").distinct().count()
    elif not name.startswith("op6"):
        assert n == table(spark, data, rows).count()


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, data, name):
    from oracle import compare

    assert compare(spark, data, LLM_QUERIES[name], LLM_ORACLES[name]) == []

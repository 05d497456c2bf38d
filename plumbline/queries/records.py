"""Saved runs, reviews, trials, lineage, prefixes and prompts: what records must hold."""

from __future__ import annotations

import asyncio

from pyspark.sql import functions as F

from ..functions.text import request_id
from ..operators import classify, decide, experiment, merkle, prepare, rag, replay, runs, validate
from ..operators.replay import Rule
from ..plans.fixtures import attempts, retrieved, scored, splits, table, traces, votes
from ..sources.io import source_prefix
from ..streaming.concurrent import evaluate_concurrently
from ..streaming.pipeline import evaluate_rag, evaluate_repeats
from .evaluation import SUMMARY, matrix
from .events import ATTEMPTS
from .registry import SCORES, query
from .runs import cases_and_attempts
from .texts import SPLITS, TRACES


@query(
    f"""WITH {TRACES} SELECT query_id, list_filter([CASE WHEN query_id % 5 = 0 AND list_sort(reranked) <> list_sort(ranked) THEN 'not_a_permutation' END, CASE WHEN query_id % 3 = 0 THEN 'context' END],
        lambda x: x IS NOT NULL) AS violations FROM tr"""
)
def trace_lineage(spark, d):
    """Every third trace has a document in its context that came from nowhere; every fifth says its reranking is complete."""
    t = traces(spark, d).withColumn("context", F.when(F.col("query_id") % 3 == 0, F.concat("context", F.array(F.lit("stranger")))).otherwise(F.col("context")))
    none = F.lit(None).cast("array<string>")
    return t.select("query_id", validate.lineage_violations(F.col("ranked"), none, F.col("reranked"), F.col("query_id") % 5 == 0, none, F.col("context")).alias("violations"))


@query(f"WITH {SCORES} SELECT vec_id, abs(sum(round(prob, 4) * CASE WHEN vec_id % 7 = 0 THEN 1.01 ELSE 1 END) - 1) <= count(*) * 5e-5 + 1e-6 AS accepted FROM scores GROUP BY vec_id")
def provider_shares(spark, d):
    """Shares rounded to four places may miss one by what rounding explains; every seventh misses it by more."""
    factor = F.when(F.col("vec_id") % 7 == 0, 1.01).otherwise(1.0)
    total = F.aggregate("shares", F.lit(0.0), lambda a, s: a + F.round(s["prob"], 4) * factor)
    return scored(spark, d).select("vec_id", (F.abs(total - 1) <= validate.provider_tolerance(F.size("shares"))).alias("accepted"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_in_source_order(spark, d):
    """A run's limit is a prefix of the source, and fails if the source is shorter."""
    return source_prefix(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT doc_id, 'Which language is this?' AS state, text AS instructions FROM documents")
def question_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("state"), F.lit("Which language is this?").alias("instructions"))
    return decide.swapped(docs)


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'req-' || event_id END AS request_id FROM events")
def request_ids(spark, d):
    """Every third id has a blank in it and is dropped."""
    raw = F.concat(F.lit("req-"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " x").otherwise(""))
    return table(spark, d, "events").select("event_id", request_id(raw).alias("request_id"))


@query("SELECT item_id AS query_id, replace(replace(text, 'the ', 'THE '), 'an', 'AN') AS rewritten, text AS asked FROM benchmark")
def rewritten_queries(spark, d):
    """Aliases become canonical names; what was asked stays as the step before."""
    q = rag.rewrite(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", {"the ": "THE ", "an": "AN"})
    return q.select("query_id", F.get("steps", F.lit(1))["value"].alias("rewritten"), F.get("steps", F.lit(0))["value"].alias("asked"))


@query(f"SELECT examples, correct, failed_or_missing, accuracy, macro_f1 FROM ({SUMMARY})")
def legacy_summary(spark, d):
    return classify.legacy_summary(classify.summary(matrix(spark, d)))


@query(f"SELECT * FROM (SELECT unnest(['examples', 'correct', 'failed_or_missing', 'accuracy', 'macro_f1']) AS metric, unnest([true, true, true, false, true]) AS agrees), (SELECT accuracy FROM ({SUMMARY}))")
def saved_run_verified(spark, d):
    """A saved summary whose accuracy was touched, against what the run's predictions give."""
    right = classify.legacy_summary(classify.summary(matrix(spark, d)))
    saved = right.withColumn("accuracy", F.col("accuracy") + 0.01)
    return runs.verify(saved, right).select("metric", "agrees").crossJoin(right.select("accuracy"))


@query(
    f"""WITH {SPLITS}, per AS (SELECT split, lang, count(DISTINCT text) AS n FROM splits GROUP BY split, lang)
    SELECT split, (SELECT count(DISTINCT text) FROM splits s WHERE s.split = per.split) AS distinct_texts, min(n) AS fewest_of_a_label FROM per GROUP BY split"""
)
def fewest_texts(spark, d):
    return prepare.fewest_texts(splits(spark, d), "lang", F.col("text"))


@query(
    """SELECT doc_id AS id, 1::BIGINT AS reviewer, 'missing' AS gap FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 2, 'repeated' FROM labels WHERE doc_id % 15 = 0
    UNION ALL SELECT doc_id, 3, 'unknown' FROM labels WHERE doc_id % 20 = 0"""
)
def review_gaps(spark, d):
    """Votes of which some are missing, some there twice, and some of a third reviewer."""
    v = votes(spark, d).where("reviewer = 2 or id % 10 <> 0")
    v = v.unionByName(v.where("reviewer = 2 and id % 15 = 0")).unionByName(v.where("reviewer = 2 and id % 20 = 0").withColumn("reviewer", F.lit(3)))
    return prepare.review_gaps(v, table(spark, d, "labels").select(F.col("doc_id").alias("id")), [1, 2])


@query(
    f"""WITH {SPLITS}, l AS (SELECT split, quality::VARCHAR AS label, sha256(concat_ws(chr(31), doc_id::VARCHAR, text, quality::VARCHAR)) AS line FROM labels JOIN splits USING (doc_id) WHERE quality = 1 - toxic),
    b AS (SELECT split, line[1:2] AS b, count(*) AS n, list(DISTINCT label) AS l, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY split, line[1:2])
    SELECT split, sum(n)::BIGINT AS examples, len(list_distinct(flatten(list(l)))) AS labels, sha256(string_agg(h, chr(10) ORDER BY b)) AS sha256 FROM b GROUP BY split"""
)
def compiled_receipt(spark, d):
    """Tickets on which both reviewers agree, compiled into splits, and a receipt of them."""
    resolved = prepare.resolve(votes(spark, d), votes(spark, d).select("id", "label").limit(0)).where("how = 'agreed'")
    return prepare.receipt(prepare.compile_splits(splits(spark, d).select(F.col("doc_id").alias("id"), "split", "text"), resolved))


def tree_sql(rows: str, most: int = 5) -> str:
    """CTEs up to `root`: k, rows, sha256 of each group's tree; rows: k, leaf. As many levels as the largest group asks for."""
    step = """n{i} AS (SELECT k, node[1:greatest(len(node) - 1, 0)] AS node, sum(n) AS n,
        CASE WHEN max(len(node)) = 0 THEN any_value(h) ELSE sha256(string_agg(node || ' ' || h, chr(10) ORDER BY node || ' ' || h)) END AS h FROM n{j} GROUP BY k, node[1:greatest(len(node) - 1, 0)])"""
    steps = ", ".join(step.format(i=i, j=i - 1) for i in range(1, most + 1))
    return f"""r0 AS ({rows}), lv AS (SELECT greatest(0, ceil(log2(max(n) / 64) / 4))::INT AS lv FROM (SELECT count(*) AS n FROM r0 GROUP BY k)),
    leaves AS (SELECT k, leaf[1:lv] AS node, leaf, count(*) AS n FROM r0, lv GROUP BY ALL),
    n0 AS (SELECT k, node, sum(n) AS n, sha256(string_agg(leaf || ' ' || n, chr(10) ORDER BY leaf || ' ' || n)) AS h FROM leaves GROUP BY k, node), {steps},
    root AS (SELECT k, n::BIGINT AS rows, h AS sha256 FROM n{most})"""


def leaf_sql(*columns: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in columns]
    return f"sha256({' || chr(124) || '.join(parts)})"


COMPILED = f"SELECT split AS k, {leaf_sql('doc_id', 'text', 'quality')} AS leaf FROM labels JOIN splits USING (doc_id) WHERE quality = 1 - toxic"
CASES = f"SELECT 0 AS k, {leaf_sql('item_id', 'text', '5')} AS leaf FROM benchmark"
ALL_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    f"""WITH {TRACES}, a AS (SELECT query_id, ranked, reranked, context, len(list_intersect(context, lit)) > 0 AS before, len(list_intersect(ranked[1:2], lit)) > 0 AS after FROM tr)
    SELECT query_id, before AS answered, after AS replay_answered, true AS bound,
        list_filter([CASE WHEN reranked <> ranked[1:5] THEN 'reranked' END, CASE WHEN context <> ranked[1:2] THEN 'context' END, CASE WHEN before <> after THEN 'answered' END], lambda x: x IS NOT NULL) AS changed FROM a"""
)
def rag_replay(spark, d):
    """Every trace replayed without its reranker: the context and the answer follow from the order of retrieval, the rest stays."""
    answered = lambda: F.size(F.array_intersect("context", "literal")) > 0
    t = traces(spark, d).withColumn("answered", answered())
    rules = [Rule("context", ("reranked",), lambda: F.slice("reranked", 1, 2)), Rule("answered", ("context", "literal"), answered), Rule("reranked", ("ranked",))]
    recorded = ["ranked", "reranked", "context", "answered"]
    again = replay.replay(t, "reranked", F.slice("ranked", 1, 5), rules, recorded, "what the reranker adds")
    found = replay.effects(t, again, ["query_id"], recorded)
    both = t.select("query_id", "answered").join(again.select("query_id", F.col("answered").alias("replay_answered")), "query_id")
    return both.join(found, "query_id")


@query(f"WITH {SPLITS}, {tree_sql(COMPILED)} SELECT k AS split, rows, sha256 FROM root")
def compiled_receipt_tree(spark, d):
    """A receipt of compiled splits that no split is too large for."""
    resolved = prepare.resolve(votes(spark, d), votes(spark, d).select("id", "label").limit(0)).where("how = 'agreed'")
    compiled = prepare.compile_splits(splits(spark, d).select(F.col("doc_id").alias("id"), "split", "text"), resolved)
    return merkle.set_digest(compiled, ["split"], ["id", "text", "label"])


@query(f"WITH {tree_sql(CASES)} SELECT rows AS cases, sha256 FROM root")
def dataset_identity(spark, d):
    """The benchmark as a dataset under a cutoff of five."""
    return merkle.dataset_identity(table(spark, d, "benchmark"), "item_id", ["text"], 5)


@query(f"WITH {tree_sql(f'SELECT 0 AS k, {leaf_sql(*ALL_COLUMNS)} AS leaf FROM documents')} SELECT rows, sha256 FROM root")
def table_digest(spark, d):
    """All documents, every column: one digest."""
    return merkle.set_digest(table(spark, d, "documents"), [], list(ALL_COLUMNS))


@query(f"WITH {TRACES} SELECT query_id::VARCHAR AS case_id, r.repeat::BIGINT AS repeat, query_id % 5 <> 0 AS bound FROM tr, range(2) r(repeat) WHERE r.repeat = 0 OR query_id % 4 <> 0")
def review_bindings(spark, d):
    """Reviews of attempts, of which every fifth case's answer has changed since."""
    cases, done = cases_and_attempts(spark, d)
    reviews = experiment.review_inputs(cases, done).select("case_id", "repeat", "review_input_sha256")
    now = done.withColumn("answer", F.when(F.col("case_id").cast("int") % 5 == 0, "b").otherwise(F.col("answer")))
    return experiment.review_bindings(cases, now, reviews)


@query(
    f"""WITH {TRACES}, m AS (SELECT query_id AS q, r.repeat AS rep, CASE WHEN query_id % 3 = 0 THEN query_id % 2 = 0 END AS c, CASE WHEN query_id % 4 = 1 THEN r.repeat = 0 END AS a
        FROM tr, range(2) r(repeat) WHERE r.repeat = 0 OR query_id % 4 <> 0)
    SELECT q::VARCHAR AS case_id, rep::BIGINT AS repeat, coalesce(a, c) AS answer_correct, coalesce(a <> c, false) AS contradicted FROM m"""
)
def merged_reviews(spark, d):
    """A dataset's verdicts and the attempts' own: the attempt's counts, and saying otherwise is reported."""
    cases, done = cases_and_attempts(spark, d)
    n = F.col("case_id").cast("int")
    cases = cases.withColumn("correct", F.when(n % 3 == 0, n % 2 == 0))
    done = done.withColumn("review_correct", F.when(n % 4 == 1, F.col("repeat") == 0))
    return experiment.merged_reviews(cases, done).select("case_id", "repeat", "answer_correct", "contradicted")


@query(
    f"""WITH {ATTEMPTS}, p AS (SELECT DISTINCT user_id % 5 AS run_id, event_type AS case_id FROM events),
    o AS (SELECT example % 5 AS run_id, event_type AS case_id, count(*) FILTER (repeat < 2) AS w, count(*) FILTER (repeat >= 2) AS s, count(*) FILTER (event_type = 'error') AS bad FROM attempts WHERE example % 5 <> 4 GROUP BY ALL),
    j AS (SELECT p.*, w, s, bad FROM p LEFT JOIN o USING (run_id, case_id))
    SELECT run_id, case_id, 'missing' AS gap FROM j WHERE w IS NULL UNION ALL SELECT run_id, case_id, 'warmups' FROM j WHERE w <> 2 UNION ALL SELECT run_id, case_id, 'samples' FROM j WHERE s <> 100
    UNION ALL SELECT run_id, case_id, 'invalid' FROM j WHERE bad > 0"""
)
def trial_gaps(spark, d):
    """Events as trials of five processes, of which the last has sent nothing."""
    a = attempts(spark, d)
    run = (F.col("example") % 5).alias("run_id")
    observed = a.where("example % 5 <> 4").select(run, F.col("event_type").alias("case_id"), F.when(F.col("repeat") < 2, "warmup").otherwise("sample").alias("phase"), F.col("choice").isNotNull().alias("valid"), F.lit("m").alias("model"))
    planned = table(spark, d, "events").select((F.col("user_id") % 5).alias("run_id"), F.col("event_type").alias("case_id")).distinct()
    return runs.trial_gaps(observed, planned, 2, 100)


@query("SELECT count(*) AS probes, count(*) FILTER (quality = 1 - toxic) AS scored, round(avg(CASE WHEN quality = 1 - toxic THEN (quality = 1)::INT END), 6) AS accuracy FROM labels")
def ambiguous_unscored(spark, d):
    """Probes on which the reviewers differ are ambiguous: they are counted and not scored."""
    both = votes(spark, d).groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("z"))
    correct = F.when(F.col("a") == F.col("z"), (F.col("a") == "1").cast("double"))
    return both.agg(F.count("*").alias("probes"), F.count(correct).alias("scored"), F.avg(correct).alias("accuracy"))


@query(f"WITH {TRACES}, g5 AS (SELECT query_id, doc_id FROM g WHERE rank = 1 AND overlap >= 5) SELECT query_id, doc_id FROM g5")
def gated_retrieval(spark, d):
    """Questions without enough evidence are never decided."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return rag.gated(items, retrieved(spark, d, 1), 5)


def _lengthy(text: str) -> str:
    if len(text) < 20:
        raise ValueError(text)
    return "long" if len(text) > 500 else "short"


@query(
    """SELECT doc_id, phase, repeat::BIGINT AS repeat, CASE WHEN length(text) >= 20 THEN CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END END AS choice, CASE WHEN length(text) < 20 THEN 'ValueError' END AS error_type
    FROM documents, (SELECT unnest(['warmup', 'sample', 'sample']) AS phase, unnest([0, 0, 1]) AS repeat)"""
)
def evaluate_repeats_scorer(spark, d):
    """A scorer over all documents: one warm-up and two repeats."""
    return evaluate_repeats(table(spark, d, "documents"), _lengthy, "text", "doc_id", 2, 1)


def _pipeline(query: str) -> dict:
    if len(query) % 7 == 0:
        raise TimeoutError(query)
    return {"context": [query[:10]], "answer": query[:5]}


def _review(query: str, output: dict) -> dict:
    if len(query) % 5 == 0:
        raise KeyError(query)
    return {"correct": output["answer"] in query and len(query) % 2 == 0}


ATTEMPTED = """SELECT item_id::VARCHAR AS case_id, r.repeat::BIGINT AS repeat, CASE WHEN length(text) % 7 <> 0 THEN text[1:5] END AS answer,
    CASE WHEN length(text) % 7 <> 0 AND length(text) % 5 <> 0 THEN length(text) % 2 = 0 END AS review_correct,
    CASE WHEN length(text) % 7 = 0 THEN 'pipeline' WHEN length(text) % 5 = 0 THEN 'review' END AS error_phase,
    CASE WHEN length(text) % 7 = 0 THEN 'TimeoutError' WHEN length(text) % 5 = 0 THEN 'KeyError' END AS error_type FROM benchmark, range(2) r(repeat)"""


@query(ATTEMPTED)
def rag_attempts(spark, d):
    """A pipeline and a reviewer in Python over all items, twice: an attempt each, failures by phase."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("query"))
    return evaluate_rag(cases, _pipeline, _review, 2).drop("context")


async def _pipeline_later(query: str) -> dict:
    await asyncio.sleep(0)
    return _pipeline(query)


async def _review_later(query: str, output: dict) -> dict:
    await asyncio.sleep(0)
    return _review(query, output)


@query(ATTEMPTED)
def rag_attempts_concurrent(spark, d):
    """The same as coroutines, sixteen attempts at once in each task."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("query"))
    return evaluate_concurrently(cases, _pipeline_later, _review_later, 2, 16).drop("context")

"""Assessment of retrieval-augmented traces at their recorded boundaries, and experiment summaries.

A trace is one wide row of nullable stage outputs. Everything about one trace is an expression over its
row; only the summary by metric shuffles, after map-side sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import total
from .overlap import MOST_TOKENS, stated, top_rows

STAGES = ["routing", "retrieval", "reranking", "context", "answer"]


def stage_status(output: Column, errors: Column, blocked: Column, stage: str) -> Column:
    return (
        F.when(output.isNotNull(), "observed")
        .when(F.coalesce(F.map_contains_key(errors, F.lit(stage)), F.lit(False)), "error")
        .when(F.coalesce(F.map_contains_key(blocked, F.lit(stage)), F.lit(False)), "blocked")
        .otherwise("not_observed")
    )


def route_correct(route: Column, acceptable: Column) -> Column:
    return F.when(route.isNotNull() & acceptable.isNotNull(), F.array_contains(acceptable, route))


def covers(route: Column, ids: Column) -> Column:
    return F.size(F.array_except(route, ids)) == 0


def source_coverage(ids: Column, routes: Column) -> Column:
    """Whether some route's sources are all among the ids; null if there are no ids or routes."""
    return F.when(ids.isNotNull() & routes.isNotNull() & (F.size(routes) > 0), F.exists(routes, lambda r: covers(r, ids)))


def reranking_coverage(ranked: Column, complete: Column, inputs: Column, routes: Column, k: int) -> Column:
    """Coverage by the first k; null where an unseen tail of a recorded prefix could still complete a route."""
    now = source_coverage(F.slice(ranked, 1, k), routes)
    room = F.lit(k) - F.size(ranked)
    could = F.exists(routes, lambda r: covers(r, inputs) & (F.size(F.array_except(r, ranked)) <= room))
    return F.when(now.isNull() | now | complete | (room <= 0), now).when(could, F.lit(None)).otherwise(F.lit(False))


def text_retained(context: Column, routes: Column, texts: Column) -> Column:
    """Whether some route's labelled texts are all literally in the context; null where unlabelled ones leave it open."""
    known = lambda r: F.filter(r, lambda i: F.map_contains_key(texts, i))
    kept = lambda r: F.forall(known(r), lambda i: F.contains(context, F.try_element_at(texts, i)))
    full = F.exists(routes, lambda r: kept(r) & (F.size(known(r)) == F.size(r)))
    open_ = F.exists(routes, lambda r: kept(r) & (F.size(known(r)) < F.size(r)))
    return F.when(context.isNotNull() & (F.size(routes) > 0), F.when(full, F.lit(True)).when(open_, F.lit(None)).otherwise(F.lit(False)))


def positives(judgments: Column) -> Column:
    return F.map_keys(F.map_filter(judgments, lambda _, g: g > 0))


def losses(judgments: Column, retrieval: Column, rerank_input: Column, reranking: Column, context_input: Column, context: Column, k: int) -> dict[str, Column]:
    """Known positives lost at each boundary, sorted; null where the boundary wasn't observed."""
    p = positives(judgments)
    return {
        "retrieval_missing": F.array_sort(F.array_except(p, retrieval)),
        "reranking_input_omitted": F.array_sort(F.array_except(F.array_intersect(p, retrieval), rerank_input)),
        "reranking_below_k": F.array_sort(F.array_intersect(p, F.slice(reranking, F.lit(k + 1), F.greatest(F.size(reranking), F.lit(1))))),
        "reranking_unreturned": F.array_sort(F.array_intersect(p, F.array_except(F.coalesce(rerank_input, retrieval), reranking))),
        "context_omitted": F.array_sort(F.array_except(F.array_intersect(p, context_input), context)),
    }


def conditional_judgments(judgments: Column, inputs: Column) -> Column:
    """Judgments of what the reranker was given."""
    return F.map_filter(judgments, lambda i, _: F.array_contains(inputs, i))


def exact_answer(answer: Column, expected: Column) -> Column:
    return strip(answer) == strip(expected)


def fixture_review(answer: Column, expected: Column, context: Column) -> Column:
    """correct (equal to what is expected), grounded (not empty, and literally in the context) and answer_words; null where answer or context wasn't observed."""
    grounded = (answer != "") & F.contains(context, answer)
    words = F.size(F.filter(F.split(strip(answer), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    review = F.struct((answer == expected).alias("correct"), grounded.alias("grounded"), words.cast("double").alias("answer_words"))
    return F.when(answer.isNotNull() & context.isNotNull(), review)


def starter_rule(results: DataFrame, dataset: str, failed: str, metric: str) -> DataFrame:
    """dataset, cases, failed, mean, passed: a starter dataset passes if nothing failed and its metric is one everywhere. results: a row a case; a failed case's metric is zero."""
    value = F.when(F.col(failed), 0.0).otherwise(F.coalesce(F.col(metric).cast("double"), F.lit(0.0)))
    per = results.groupBy(dataset).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col(failed)).alias("failed"), F.avg(value).alias("mean"))
    return per.withColumn("passed", (F.col("failed") == 0) & (F.col("mean") == 1))


def plan(cases: DataFrame, repeats: int) -> DataFrame:
    """case_id, repeat of every planned attempt."""
    return cases.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def _mean(value: Column) -> Column:
    """A mean whose sum can't overflow: values are scaled by a power of two, which changes no digit."""
    return F.avg(value * F.lit(2.0**-60)) * F.lit(2.0**60)


def metric_summary(values: DataFrame, planned: DataFrame) -> DataFrame:
    """metric, mean, observed, unknown, coverage, minimum, maximum, stddev; values: metric, value (nulls unknown); planned: one row, eligible."""
    got = values.groupBy("metric").agg(
        _mean(F.col("value")).alias("mean"), F.count("value").alias("observed"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("stddev")
    )
    out = got.crossJoin(F.broadcast(planned))
    unknown = F.col("eligible") - F.col("observed")
    coverage = F.when(F.col("eligible") > 0, F.col("observed") / F.col("eligible")).otherwise(0.0)
    return out.select("metric", "mean", "observed", unknown.alias("unknown"), coverage.alias("coverage"), "minimum", "maximum", "stddev")


def gates(summary: DataFrame, rules: DataFrame) -> DataFrame:
    """metric, status (passed, failed, unknown); rules: metric, minimum, maximum, min_coverage."""
    s = summary.select("metric", F.col("mean").alias("m"), F.col("coverage").alias("c"))
    both = rules.join(s, "metric", "left")
    outside = F.coalesce(F.col("m") < F.col("minimum"), F.lit(False)) | F.coalesce(F.col("m") > F.col("maximum"), F.lit(False))
    status = F.when(F.col("m").isNull() | (F.col("c") < F.col("min_coverage")), "unknown").when(outside, "failed").otherwise("passed")
    return both.select("metric", status.alias("status"))


def passed(results: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    """keys, status and passed (null without gates); state: a row for each run (keys): missing, failures, diagnostic."""
    one = results.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "passed").alias("bad"))
    status = F.when(F.col("missing") > 0, "incomplete").when(F.col("failures") > 0, "failed").otherwise("complete")
    ok = F.when(F.col("n") > 0, (status == "complete") & (F.col("diagnostic") == 0) & (F.col("bad") == 0))
    return state.crossJoin(F.broadcast(one)).select(*keys, status.alias("status"), ok.alias("passed"))


def unstable(outputs: DataFrame) -> DataFrame:
    """Cases whose outputs differ between repeats; outputs: case_id, output."""
    return outputs.groupBy("case_id").agg(F.count_distinct(F.sha2(F.col("output").cast("string"), 256)).alias("n")).where("n > 1").select("case_id", F.col("n").alias("outputs"))


def lexical_retrieval(corpus: DataFrame, queries: DataFrame, top: int, most: int = 10_000) -> DataFrame:
    """query_id, doc_id, overlap, rank: the documents that share most distinct tokens with a query; ties to the smaller doc_id.

    corpus: doc_id, tokens (distinct). queries: query_id, tokens; a stated set of at most `most` with a million tokens in
    all, which is checked. Common tokens form no pairs where the best documents share more than these (overlap.py).
    """
    asks = stated(queries, "query_id", "tokens")
    if asks is None:
        raise ValueError(f"the queries have more than {MOST_TOKENS} tokens in all")
    if len(asks) > most:
        raise ValueError(f"{len(asks)} queries; at most {most} are sent to every task")
    found = top_rows(corpus, "doc_id", "tokens", asks, top)
    return found.select(F.col("ask").alias("query_id"), F.col("key").alias("doc_id"), F.col("overlap").cast("int").alias("overlap"), "rank")


def rewrite(queries: DataFrame, text: str, aliases: dict[str, str]) -> DataFrame:
    """Adds `rewritten`, with each alias as its canonical name, and `steps`: what was asked and what it became."""
    out = F.col(text)
    for alias, name in aliases.items():
        out = F.replace(out, F.lit(alias), F.lit(name))
    steps = F.array(F.struct(F.lit("query").alias("step"), F.col(text).alias("value")), F.struct(F.lit("rewrite").alias("step"), F.col("rewritten").alias("value")))
    return queries.withColumn("rewritten", out).withColumn("steps", steps)


def gated(queries: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """query_id, doc_id of the first document found, only where the evidence is enough: others cost no decision."""
    return queries.select("query_id").join(found.where((F.col("rank") == 1) & (F.col("overlap") >= least)).select("query_id", "doc_id"), "query_id")


def pack_context(found: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """query_id, ids, context: the first texts joined by empty lines."""
    some = found.where(F.col("rank") <= top).join(texts, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text")))
    out = some.groupBy("query_id").agg(ordered.alias("o"))
    return out.select("query_id", F.transform("o", lambda x: x["doc_id"]).alias("ids"), F.array_join(F.transform("o", lambda x: x["text"]), "\n\n").alias("context"))


def mean_of(values: Column) -> Column:
    return total(values) / F.size(values)

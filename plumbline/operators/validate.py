"""Constraints as columns: each check names what is wrong with a row, and nothing is dropped or thrown.

A row's `violations` is an array of codes, never of values, so reports can't leak texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.vectors import finite, let, total
from .decide import MAX_CANDIDATES, MAX_ID, MAX_QUESTIONS, MAX_REQUEST, MAX_TEXT, choice


def violations(**checks: Column) -> Column:
    """Names of the checks that are true; unknown counts as true."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def text_limits(text: Column) -> dict[str, Column]:
    return {"missing": text.isNull(), "blank": F.coalesce(is_blank(text), F.lit(False)), "too_long": F.coalesce(F.length(text) > MAX_TEXT, F.lit(False))}


def request_limits(candidates: DataFrame) -> DataFrame:
    """request_id, questions, candidates, chars, violations; candidates: request_id, state, question_id, instructions, id, text."""
    q = candidates.groupBy("request_id", "question_id").agg(F.first("state").alias("state"), F.first("instructions").alias("i"), F.count("*").alias("n"), F.sum(F.length("id") + F.length("text")).alias("c"), F.max(F.length("id")).alias("longest"), F.count_if(is_blank(F.col("text"))).alias("blank"))
    r = q.groupBy("request_id").agg(
        F.count("*").alias("questions"),
        F.sum("n").alias("candidates"),
        (F.max(F.length("state")) + F.sum(F.length("question_id") + F.length("i") + F.col("c"))).alias("chars"),
        F.max("longest").alias("longest"),
        F.sum("blank").alias("blank"),
    )
    bad = violations(questions=F.col("questions") > MAX_QUESTIONS, candidates=F.col("candidates") > MAX_CANDIDATES, chars=F.col("chars") > MAX_REQUEST, ids=F.col("longest") > MAX_ID, blank=F.col("blank") > 0)
    return r.select("request_id", "questions", "candidates", "chars", bad.alias("violations"))


def token_budget(lengths: Column, longest: int, most: int = 16_384) -> Column:
    """Every row 1 to longest tokens, and all together at most `most`; nothing is cut."""
    return F.forall(lengths, lambda n: (n >= 1) & (n <= longest)) & (F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n) <= most)


def share_violations(shares: Column, chosen: Column, tolerance: float = 1e-6) -> Column:
    """What is wrong with recorded shares: numbers, sum, softmax of the scores, first maximum."""
    probs, scores = F.transform(shares, lambda s: s["prob"]), F.transform(shares, lambda s: s["score"])
    top = F.array_max(scores)
    raised = let(top, lambda t: total(F.transform(scores, lambda s: F.exp(s - t))))
    return violations(
        not_finite=~F.forall(F.concat(probs, scores), lambda x: x.isNotNull() & finite(x)),
        out_of_range=~F.forall(probs, lambda p: (p >= 0) & (p <= 1)),
        sum=F.abs(total(probs) - 1) > tolerance,
        softmax=let(top, lambda t: let(raised, lambda z: F.exists(shares, lambda s: F.abs(s["prob"] - F.exp(s["score"] - t) / z) > tolerance))),
        choice=~chosen.eqNullSafe(choice(shares)),
    )


def prediction_violations(predictions: DataFrame, examples: DataFrame, labels: DataFrame) -> DataFrame:
    """violation, n over predictions (id, choice, ranking): unknown ids, repeated ids, unknown labels, broken rankings."""
    known = F.broadcast(labels.agg(F.array_sort(F.collect_set("id")).alias("labels")))  # labels: at most 256
    p = predictions.crossJoin(known)
    broken = F.col("ranking").isNotNull() & ((F.array_sort("ranking") != F.col("labels")) | (F.get("ranking", F.lit(0)) != F.col("choice")))
    rows = p.agg(F.count_if(F.col("choice").isNotNull() & ~F.array_contains("labels", F.col("choice"))).alias("unknown_label"), F.count_if(broken).alias("broken_ranking"))
    unknown = predictions.join(examples.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown_id"))
    again = predictions.groupBy("id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_id"))
    missing = examples.join(predictions.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))
    one = rows.crossJoin(unknown).crossJoin(again).crossJoin(missing)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("violation"), F.col(c).alias("n")) for c in ("unknown_id", "repeated_id", "unknown_label", "broken_ranking", "missing")])))


def response_mismatch(request: DataFrame, response: DataFrame) -> DataFrame:
    """Rows on which request and response differ; both: question_id, ord, id. Empty: they agree."""
    keys = ["question_id", "ord", "id"]
    return request.select(*keys).exceptAll(response.select(*keys)).withColumn("side", F.lit("request")).unionAll(response.select(*keys).exceptAll(request.select(*keys)).withColumn("side", F.lit("response")))


def lineage_violations(retrieval: Column, rerank_input: Column, reranking: Column, complete: Column, context_input: Column, context: Column) -> Column:
    """Subset rules between a trace's stages; unobserved stages break none."""
    outside = lambda a, b: F.coalesce(F.size(F.array_except(a, b)) > 0, F.lit(False))
    ranked_from = F.coalesce(rerank_input, retrieval)
    return violations(
        rerank_input=outside(rerank_input, retrieval),
        reranking=outside(reranking, ranked_from),
        not_a_permutation=F.coalesce(complete & (F.array_sort(reranking) != F.array_sort(ranked_from)), F.lit(False)),
        context_input=outside(context_input, F.coalesce(reranking, retrieval)),
        context=outside(context, F.coalesce(context_input, reranking, retrieval)),
    )


def provider_tolerance(candidates: Column, rounding: float = 5e-5) -> Column:
    """How far a provider's rounded shares may sum from one."""
    return candidates * F.lit(rounding) + F.lit(1e-6)

"""Experiments with retrieval-augmented pipelines: plan, validate, assess, summarise, gate.

Cases and attempts are tables (schemas.RAG_CASE, schemas.RAG_ATTEMPT). They meet in one join on the case;
the assessment is then an expression over each row, and metrics are turned to rows only to be summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rag, ranking

RANKED = ["retrieval", "reranking", "shortlist_reranking"]


def inputs(cases: DataFrame, repeats: int, system: str) -> DataFrame:
    """What a pipeline is given for each planned attempt: no judgments."""
    return rag.plan(cases.select("case_id", "query", "parameters"), repeats).withColumn("system", F.lit(system))


def review_inputs(cases: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a reviewer is given, with a fingerprint that binds the review to it."""
    both = attempts.where("error_phase is null").join(cases.select("case_id", F.col("query").alias("asked")), "case_id")
    print_ = F.sha2(F.concat_ws("\x1f", "case_id", F.col("repeat").cast("string"), "asked", F.coalesce("context_text", F.lit("")), F.coalesce("answer", F.lit("")), F.coalesce("output_sha256", F.lit(""))), 256)
    return both.select("case_id", "repeat", F.col("asked").alias("query"), "context_text", "answer", print_.alias("review_input_sha256"))


def invalid_attempts(cases: DataFrame, attempts: DataFrame, repeats: int, system: str) -> DataFrame:
    """case_id, repeat, violation: unknown case, changed query or system, repeat out of range, repeated attempt."""
    w = Window.partitionBy("case_id", "repeat")
    both = attempts.join(cases.select("case_id", F.col("query").alias("asked"), F.lit(True).alias("known")), "case_id", "left").withColumn("n", F.count("*").over(w))
    checks = {
        "unknown_case": F.col("known").isNull(),
        "changed_query": F.col("known").isNotNull() & ~F.col("query").eqNullSafe(F.col("asked")),
        "changed_system": ~F.col("system").eqNullSafe(F.lit(system)),
        "repeat_out_of_range": (F.col("repeat") < 0) | (F.col("repeat") >= repeats),
        "repeated_attempt": F.col("n") > 1,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return both.select("case_id", "repeat", F.explode(found).alias("violation"))


def contradictions(cases: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts whose review says other than their case's."""
    both = attempts.join(cases.select("case_id", "correct", "grounded"), "case_id")
    return both.where("(correct <> review_correct) or (grounded <> review_grounded)").select("case_id", "repeat")


def review_bindings(cases: DataFrame, attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """case_id, repeat, bound: whether a review was made of what its attempt says now.

    reviews: case_id, repeat, review_input_sha256. A review without an attempt that can be reviewed is unbound.
    """
    now = review_inputs(cases, attempts).select("case_id", "repeat", F.col("review_input_sha256").alias("now_"))
    both = reviews.join(now, ["case_id", "repeat"], "left")
    return both.select("case_id", "repeat", F.coalesce(F.col("review_input_sha256") == F.col("now_"), F.lit(False)).alias("bound"))


def merged_reviews(cases: DataFrame, attempts: DataFrame) -> DataFrame:
    """case_id, repeat, answer_correct, answer_grounded, contradicted: an attempt's review first, its case's where it has none."""
    both = attempts.select("case_id", "repeat", "review_correct", "review_grounded").join(cases.select("case_id", "correct", "grounded"), "case_id")
    against = F.coalesce(F.col("correct") != F.col("review_correct"), F.lit(False)) | F.coalesce(F.col("grounded") != F.col("review_grounded"), F.lit(False))
    return both.select("case_id", "repeat", F.coalesce("review_correct", "correct").alias("answer_correct"), F.coalesce("review_grounded", "grounded").alias("answer_grounded"), against.alias("contradicted"))


def assess(cases: DataFrame, attempts: DataFrame, k: int) -> DataFrame:
    """Attempts with judgments, in order of case and repeat, and everything that can be said of each trace."""
    both = attempts.join(cases.drop("query"), "case_id")
    c = F.col
    inputs_ = F.coalesce(c("reranking_input"), c("retrieval"))
    complete = F.coalesce(c("reranking_complete"), F.lit(True)) | (F.size("reranking") == F.size(inputs_))
    seen = both.withColumns({"inputs_": inputs_, "complete_": F.coalesce(complete, F.lit(True)), "shortlist_": rag.conditional_judgments(c("relevance"), inputs_)})
    out = {f"status_{s}": rag.stage_status(o, c("errors"), c("blocked"), s) for s, o in zip(rag.STAGES, [c("route"), c("retrieval"), c("reranking"), c("context"), c("answer")], strict=True)}
    out["routing_correct"] = rag.route_correct(c("route"), c("acceptable_routes"))
    for name, ids, judged, done in (("retrieval", "retrieval", "relevance", F.lit(True)), ("reranking", "reranking", "relevance", c("complete_")), ("shortlist_reranking", "reranking", "shortlist_", c("complete_"))):
        m = ranking.assess(c(ids), c(judged), k, done)
        out[name] = F.when(c(ids).isNotNull(), F.struct(*[m[x].alias(x) for x in ranking.REASONS]))
    out["source_coverage_retrieval"] = rag.source_coverage(c("retrieval"), c("evidence_sets"))
    out["source_coverage_reranking_top_k"] = F.when(c("reranking").isNotNull(), rag.reranking_coverage(c("reranking"), c("complete_"), c("inputs_"), c("evidence_sets"), k))
    out["source_coverage_context"] = rag.source_coverage(c("context"), c("evidence_sets"))
    out["required_text_retained"] = rag.text_retained(c("context_text"), c("evidence_sets"), c("evidence_texts"))
    out["answer_correct"] = F.coalesce(c("review_correct"), c("correct"))
    out["answer_grounded"] = F.coalesce(c("review_grounded"), c("grounded"))
    out["losses"] = F.struct(*[x.alias(n) for n, x in rag.losses(c("relevance"), c("retrieval"), c("reranking_input"), c("reranking"), F.coalesce(c("context_input"), c("reranking"), c("retrieval")), c("context"), k).items()])
    out["diagnostic"] = F.coalesce(c("replay"), F.lit(False))
    assessed = seen
    for n, x in out.items():
        assessed = assessed.withColumn(n if n not in seen.columns else f"{n}_metrics", x)
    return assessed.drop("inputs_", "complete_", "shortlist_")


def _metrics() -> list[tuple[str, Column]]:
    c, number = F.col, lambda x: x.cast("double")
    out = [("routing.correct", number(c("routing_correct")))]
    for stage in RANKED:
        at = f"{stage}_metrics" if stage != "shortlist_reranking" else stage
        out += [(f"{stage}.{m}", c(f"{at}.{m}")) for m in ranking.REASONS]
    out += [(f"source_coverage.{s}", number(c(f"source_coverage_{s}"))) for s in ("retrieval", "reranking_top_k", "context")]
    out += [("context.required_text_retained", number(c("required_text_retained"))), ("answer.correct", number(c("answer_correct"))), ("answer.grounded", number(c("answer_grounded")))]
    return [*out, ("pipeline.duration_seconds", c("duration_seconds")), ("review.duration_seconds", c("review_duration_seconds"))]


def values(assessed: DataFrame) -> DataFrame:
    """case_id, repeat, metric, value of attempts that count: the fixed metrics and custom.* of their reviews."""
    fixed = F.array(*[F.struct(F.lit(n).alias("metric"), x.alias("value")) for n, x in _metrics()])
    own = F.transform(F.map_entries("review_scores"), lambda e: F.struct(F.concat(F.lit("custom."), e["key"]).alias("metric"), e["value"].alias("value")))
    none = F.array().cast("array<struct<metric:string,value:double>>")
    return assessed.where(~F.col("diagnostic")).select("case_id", "repeat", F.inline(F.concat(fixed, F.coalesce(own, none))))


def _counted(column: str) -> Column:
    return F.when(~F.col("diagnostic"), F.col(column))


def state(cases: DataFrame, assessed: DataFrame, repeats: int) -> DataFrame:
    """One row: planned, recorded, missing, failures, stage_errors, diagnostic, unstable, eligible."""
    per = assessed.groupBy("case_id").agg(
        F.count("*").alias("recorded"),
        F.count_if(F.col("error_phase").isNotNull()).alias("attempt_failures"),
        F.sum(F.coalesce(F.size(F.map_keys("errors")), F.lit(0)) + F.coalesce(F.size("step_errors"), F.lit(0))).alias("stage_errors"),
        F.count_if("diagnostic").alias("diagnostic"),
        (F.min(_counted("output_sha256")) < F.max(_counted("output_sha256"))).alias("differs"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("recorded", "attempt_failures", "stage_errors", "diagnostic")]
    one = cases.select("case_id").join(per, "case_id", "left").agg((F.count("*") * repeats).alias("planned"), *sums, F.count_if("differs").alias("unstable"))
    failures = F.col("attempt_failures") + F.coalesce("stage_errors", F.lit(0))
    return one.select("planned", "recorded", (F.col("planned") - F.col("recorded")).alias("missing"), failures.alias("failures"), F.coalesce("stage_errors", F.lit(0)).alias("stage_errors"), "diagnostic", "unstable", (F.col("planned") - F.col("diagnostic")).alias("eligible"))


def report(cases: DataFrame, attempts: DataFrame, gates: DataFrame, k: int, repeats: int) -> dict[str, DataFrame]:
    """summary by metric, gate results, run state, and the verdict."""
    assessed = assess(cases, attempts, k)
    run = state(cases, assessed, repeats)
    summary = rag.metric_summary(values(assessed), run.select("eligible"))
    results = rag.gates(summary, gates)
    return {"assessed": assessed, "summary": summary, "gates": results, "state": run, "verdict": rag.passed(results, run)}

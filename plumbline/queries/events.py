"""Latency, run summaries, speed comparison and experiment bookkeeping over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, rag, timing
from ..plans.fixtures import attempts, table, trials
from ..shared import saved, shared_dir
from ..sources.io import validated_json
from ..streaming.identity import run_checked
from .registry import query

ATTEMPTS = """attempts AS (SELECT user_id AS example, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS repeat,
    CASE WHEN event_type <> 'error' THEN event_type END AS choice, value AS seconds, (props->>'$.k')::BIGINT AS tokens, event_id, event_type FROM events)"""
DIST = """count(seconds) AS calls, round(avg(seconds), 6) AS mean_seconds, round(quantile_cont(seconds, 0.5), 6) AS median_seconds,
    CASE WHEN count(seconds) >= 20 THEN round(quantile_cont(seconds, 0.95), 6) END AS p95_seconds, round(min(seconds), 6) AS min_seconds, round(max(seconds), 6) AS max_seconds"""


@query(f"WITH {ATTEMPTS} SELECT example, event_type, {DIST} FROM attempts GROUP BY example, event_type")
def latency_distribution(spark, d):
    return timing.latencies(attempts(spark, d), ["example", "event_type"], "seconds")


@query(f"WITH {ATTEMPTS} SELECT example, round(stddev_pop(seconds) / avg(seconds), 6) AS cv FROM attempts GROUP BY example")
def latency_cv(spark, d):
    return attempts(spark, d).groupBy("example").agg(timing.variation(F.col("seconds")).alias("cv"))


@query(
    f"""WITH {ATTEMPTS} SELECT example, round(max(seconds) FILTER (repeat = 0), 6) AS first_seconds, round(quantile_cont(seconds, 0.5) FILTER (repeat > 0), 6) AS warm_median_seconds,
    round(min(seconds) FILTER (repeat > 0), 6) AS warm_min_seconds, round(max(seconds) FILTER (repeat > 0), 6) AS warm_max_seconds FROM attempts GROUP BY example"""
)
def warm_vs_first_timing(spark, d):
    return timing.first_and_warm(attempts(spark, d), "example")


@query(
    f"""WITH {ATTEMPTS}, per AS (SELECT example, count(DISTINCT choice) AS c, max(choice) FILTER (repeat = 0) AS f, count(*) AS n, count(choice) AS ok, sum(seconds) AS s FROM attempts GROUP BY example)
    SELECT count(*) AS attempted_examples, sum(n - ok)::BIGINT AS failed_calls, count(*) FILTER (c > 1) AS unstable_examples, count(*) FILTER (f IS NULL) AS failed_first_attempts,
    round(sum(ok) / sum(s), 6) AS successful_calls_per_second FROM per"""
)
def run_summary(spark, d):
    return timing.run_summary(attempts(spark, d))


@query(
    f"""WITH {ATTEMPTS}, s AS (SELECT example, event_type, repeat, CASE WHEN choice IS NOT NULL THEN seconds END AS score FROM attempts),
    f AS (SELECT *, first_value(score IGNORE NULLS) OVER (PARTITION BY example, event_type ORDER BY repeat ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM s)
    SELECT example, round(coalesce(max(abs(score - first)), 0), 6) AS max_score_drift FROM f GROUP BY example"""
)
def score_drift_from_first_success(spark, d):
    a = attempts(spark, d).select("example", F.col("event_type").alias("candidate"), "repeat", F.when(F.col("choice").isNotNull(), F.col("seconds")).alias("score"))
    return timing.drift_from_first(a)


QUALITY = f"""WITH {ATTEMPTS} SELECT example, round(count(*) FILTER (choice = 'click') / (SELECT max(repeat) + 1 FROM attempts), 6) AS quality, round(sum(tokens) / sum(seconds), 6) AS tokens_per_second,
    round(count(*) / sum(seconds), 6) AS requests_per_second FROM attempts GROUP BY example"""


@query(QUALITY)
@query(QUALITY, name="fixed_denominator_quality_all")
def fixed_denominator_quality(spark, d):
    """All calls, against the greatest number of calls of any user."""
    a = attempts(spark, d).withColumn("correct", F.coalesce(F.col("choice") == "click", F.lit(False)))
    return timing.fixed_denominator(a)


@query(f"WITH {ATTEMPTS} SELECT event_type, round(max(seconds), 6) AS high_water FROM attempts GROUP BY event_type")
def memory_high_water(spark, d):
    return timing.high_water(attempts(spark, d), "event_type", "seconds")


SPEED = """trials AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS system, 'p' || user_id % 5 AS run_id, event_type AS case_id, value AS seconds FROM events),
    per_run AS (SELECT system, case_id, run_id, quantile_cont(seconds, 0.5) AS m FROM trials GROUP BY ALL),
    per_case AS (SELECT system, case_id, quantile_cont(m, 0.5) AS m FROM per_run GROUP BY ALL),
    speed AS (SELECT case_id, max(m) FILTER (system = 'baseline') / max(m) FILTER (system = 'candidate') AS speedup FROM per_case GROUP BY case_id)"""


@query(f"WITH {SPEED} SELECT case_id, round(speedup, 6) AS speedup FROM speed")
def perf_speedups(spark, d):
    return compare.speedups(trials(spark, d))


@query(f"WITH {SPEED} SELECT count(*) AS cases, round(exp(avg(ln(speedup))), 6) AS geomean_speedup, round(1 / min(speedup), 6) AS max_case_regression FROM speed")
def perf_compare_geomean(spark, d):
    return compare.speed_report(compare.speedups(trials(spark, d)))


@query()
def bootstrap_speedup(spark, d):
    """Resamples come from a Mersenne twister, which SQL hasn't; tests hold it against plain Python."""
    return compare.bootstrap_speedup(trials(spark, d))


@query(f"WITH {ATTEMPTS} SELECT example, repeat, coalesce(choice, 'review') AS queue, coalesce(choice = 'click', false) AS correct FROM attempts")
def review_queue_fallback(spark, d):
    """Failed calls go to people; in metrics they stay wrong."""
    a = attempts(spark, d)
    return a.select("example", "repeat", F.coalesce("choice", F.lit("review")).alias("queue"), F.coalesce(F.col("choice") == "click", F.lit(False)).alias("correct"))


@query("SELECT event_id, event_id % 7 <> 0 AS valid, CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::BIGINT END AS k FROM events")
def json_props_validated(spark, d):
    """Every seventh record is given a repeated key, which parsing alone would merge."""
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"k":0,'), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    ok = validated_json(raw)
    return e.select("event_id", ok.alias("valid"), F.when(ok, F.get_json_object(raw, "$.k").cast("bigint")).alias("k"))


PLAN = f"""{ATTEMPTS}, cases AS (SELECT DISTINCT user_id AS case_id FROM events), planned AS (SELECT case_id, unnest(range(80)) AS repeat FROM cases)"""


@query(f"WITH {PLAN} SELECT p.case_id, count(*) AS planned, count(a.example) AS recorded, count(*) - count(a.example) AS missing FROM planned p LEFT JOIN attempts a ON a.example = p.case_id AND a.repeat = p.repeat GROUP BY p.case_id")
def rag_plan_missing(spark, d):
    cases = table(spark, d, "events").select(F.col("user_id").alias("case_id")).distinct()
    done = attempts(spark, d).select(F.col("example").alias("case_id"), "repeat", F.lit(1).alias("done"))
    both = rag.plan(cases, 80).join(done, ["case_id", "repeat"], "left")
    return both.groupBy("case_id").agg(F.count("*").alias("planned"), F.count("done").alias("recorded"), (F.count("*") - F.count("done")).alias("missing"))


@query(f"WITH {ATTEMPTS} SELECT example AS case_id, count(DISTINCT choice) AS outputs FROM attempts WHERE choice IS NOT NULL GROUP BY example HAVING count(DISTINCT choice) > 1")
def rag_unstable_cases(spark, d):
    return rag.unstable(attempts(spark, d).where("choice is not null").select(F.col("example").alias("case_id"), F.col("choice").alias("output")))


VALUES = f"""{ATTEMPTS}, vals AS (SELECT 'pipeline.duration_seconds' AS metric, seconds::DOUBLE AS value FROM attempts UNION ALL SELECT 'answer.correct', (choice = 'click')::INT::DOUBLE FROM attempts
    UNION ALL SELECT 'custom.tokens', tokens::DOUBLE FROM attempts WHERE choice IS NOT NULL),
    e AS (SELECT count(*) + 100 AS eligible FROM attempts),
    summary AS (SELECT metric, avg(value) AS mean, count(value) AS observed, any_value(eligible) - count(value) AS unknown, count(value) / any_value(eligible) AS coverage, min(value) AS minimum, max(value) AS maximum,
        stddev_pop(value) AS stddev FROM vals, e GROUP BY metric)"""


def values(spark, d):
    a = attempts(spark, d)
    three = F.array(
        F.struct(F.lit("pipeline.duration_seconds").alias("metric"), F.col("seconds").alias("value")),
        F.struct(F.lit("answer.correct").alias("metric"), (F.col("choice") == "click").cast("double").alias("value")),
        F.struct(F.lit("custom.tokens").alias("metric"), F.when(F.col("choice").isNotNull(), F.col("tokens").cast("double")).alias("value")),
    )
    return rag.metric_summary(a.select(F.inline(three)), a.agg((F.count("*") + 100).alias("eligible")))


@query(
    f"""WITH {VALUES} SELECT metric, round(mean, 6) AS mean, observed, unknown, round(coverage, 6) AS coverage, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(stddev, 6) AS stddev FROM summary"""
)
def rag_metric_summary(spark, d):
    """A hundred planned attempts weren't recorded: they count as unknown."""
    return values(spark, d)


GATES = "gates AS (SELECT unnest(['pipeline.duration_seconds', 'answer.correct', 'custom.tokens', 'no.such']) AS metric, unnest([NULL, 0.1, 1000.0, 0.0])::DOUBLE AS lo, unnest([100.0, NULL, NULL, NULL])::DOUBLE AS hi, unnest([0.9, 0.5, 0.5, 1.0])::DOUBLE AS cov)"
RULES = [("pipeline.duration_seconds", None, 100.0, 0.9), ("answer.correct", 0.1, None, 0.5), ("custom.tokens", 1000.0, None, 0.5), ("no.such", 0.0, None, 1.0)]


@query(f"WITH {VALUES}, {GATES} SELECT g.metric, CASE WHEN mean IS NULL OR coverage < cov THEN 'unknown' WHEN mean < lo OR mean > hi THEN 'failed' ELSE 'passed' END AS status FROM gates g LEFT JOIN summary s USING (metric)")
def rag_gates(spark, d):
    return rag.gates(values(spark, d), spark.createDataFrame(RULES, "metric string, minimum double, maximum double, min_coverage double"))


@query("SELECT 'incomplete' AS status, false AS passed")
def rag_pass_rule(spark, d):
    results = rag.gates(values(spark, d), spark.createDataFrame(RULES, "metric string, minimum double, maximum double, min_coverage double"))
    state = attempts(spark, d).agg(F.lit(100).alias("missing"), F.count_if(F.col("choice").isNull()).alias("failures"), F.lit(0).alias("diagnostic"))
    return rag.passed(results, state)


@query(
    f"""WITH {VALUES}, {GATES}, g AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(coverage >= cov AND NOT coalesce(mean < lo, false) AND NOT coalesce(mean > hi, false), false)) AS bad FROM gates LEFT JOIN summary USING (metric) WHERE metric <> 'no.such'),
    s AS (SELECT event_type AS run, 0 AS diagnostic, count(*) FILTER (choice IS NULL) AS failures, (SELECT max(n) FROM (SELECT count(*) AS n FROM attempts GROUP BY event_type)) - count(*) AS missing FROM attempts GROUP BY event_type)
    SELECT run, CASE WHEN missing > 0 THEN 'incomplete' WHEN failures > 0 THEN 'failed' ELSE 'complete' END AS status, missing = 0 AND failures = 0 AND bad = 0 AS passed FROM s, g"""
)
def rag_pass_rules(spark, d):
    """Event types as runs that are planned to be as long as the longest, under the gates that have values."""
    results = rag.gates(values(spark, d), spark.createDataFrame([r for r in RULES if r[0] != "no.such"], "metric string, minimum double, maximum double, min_coverage double"))
    per = attempts(spark, d).groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("choice").isNull()).alias("failures"))
    state = per.crossJoin(F.broadcast(per.agg(F.max("n").alias("planned")))).select("run", (F.col("planned") - F.col("n")).alias("missing"), "failures", F.lit(0).alias("diagnostic"))
    return rag.passed(results, state, "run")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_day_counts(spark, d):
    """The batch form of the stream's windowed counts."""
    from ..streaming.pipeline import windowed_counts

    w = windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 day", "event_type")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query(
    f"""WITH {ATTEMPTS}, m AS (SELECT example, repeat, CASE WHEN event_id % 11 = 0 THEN 'm2' ELSE 'm1' END AS model, choice, CASE WHEN choice IS NULL THEN 'Timeout' END AS error_type FROM attempts),
    f AS (SELECT *, first_value(CASE WHEN choice IS NOT NULL THEN model END IGNORE NULLS) OVER (PARTITION BY example ORDER BY repeat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM m),
    c AS (SELECT example, repeat, model, CASE WHEN choice IS NOT NULL AND model <> first THEN NULL ELSE choice END AS choice, CASE WHEN choice IS NOT NULL AND model <> first THEN 'ModelChanged' ELSE error_type END AS error_type FROM f)
    SELECT *, (count(*) FILTER (choice IS NULL) OVER (PARTITION BY example ORDER BY repeat)) AS failures FROM c"""
)
def stream_identity(spark, d):
    """All attempts as a stream in four deliveries of repeats, the third of them twice; a model other than the example's first is a failure.

    The stream is stopped after two deliveries and started again for the others.
    """
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    a = attempts(spark, d).select("example", "repeat", F.when(F.col("event_id") % 11 == 0, "m2").otherwise("m1").alias("model"), "choice", F.when(F.col("choice").isNull(), "Timeout").alias("error_type"))
    a = a.select(F.col("example").cast("bigint").alias("example"), F.col("repeat").cast("bigint").alias("repeat"), "model", "choice", "error_type")
    a = saved(a, "attempts")  # numbered once, not for each delivery
    fourth = F.least(F.floor(F.col("repeat") / 25), F.lit(3))
    for parts in ((0, 1), (2, 2, 3)):
        for part in parts:
            a.where(fourth == part).write.mode("append").parquet(f"{place}/in")
        source = spark.readStream.schema(a.schema).parquet(f"{place}/in")
        run_checked(source, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out")

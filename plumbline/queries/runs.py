"""Pooling and heads, saved runs, comparisons under provenance rules, whole experiments."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify, experiment, heads, reuse, runs, timing
from ..plans.fixtures import attempts, judged, labels, predictions, table, vectors, with_missing
from ..shared import saved, shared_dir
from ..sources.receipts import load_report, load_run, receipts, save_report, save_run
from .events import ATTEMPTS
from .registry import MATRIX, SCORES, query
from .texts import TRACES


@query(
    """WITH t AS (SELECT vec_id, vec_id % 8 AS last, (embedding::DOUBLE[])[(vec_id % 8) * 8 + 1 : (vec_id % 8) * 8 + 8] AS v FROM embeddings)
    SELECT vec_id, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS first, round(list_sum(v) / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS total FROM t"""
)
def pool_normalise(spark, d):
    """Vectors as eight tokens of eight components, of which the first vec_id % 8 + 1 are real."""
    v = vectors(spark, d)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vector", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    p = v.select("vec_id", heads.pool(tokens, mask).alias("p"))
    return p.select("vec_id", F.get("p", F.lit(0)).alias("first"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    """WITH h AS (SELECT vec_id, list_transform(range(4), lambda j: greatest(0, list_sum(list_transform(range(64), lambda i: sin(j * 64 + i) * (embedding::DOUBLE[])[i + 1])) + 0.1 * j)) AS y FROM embeddings)
    SELECT vec_id, round(y[1] / (sqrt(list_dot_product(y, y)) + 1e-12), 6) AS y0, round(y[4] / (sqrt(list_dot_product(y, y)) + 1e-12), 6) AS y3 FROM h"""
)
def projection_head(spark, d):
    """A linear layer with a rectifier, weights by formula."""
    w = np.sin(np.arange(4)[None, :] * 64 + np.arange(64)[:, None])
    project = heads.head(spark, [heads.Layer(w, 0.1 * np.arange(4), "relu")])
    y = vectors(spark, d).select("vec_id", project(F.col("vector")).alias("y"))
    return y.select("vec_id", F.get("y", F.lit(0)).alias("y0"), F.get("y", F.lit(3)).alias("y3"))


@query(f"WITH {ATTEMPTS} SELECT example AS id, choice, (SELECT count(*) FILTER (choice IS NULL) = 0 FROM attempts) AS run_complete FROM attempts WHERE repeat = 0")
def first_attempt_predictions(spark, d):
    return runs.first_attempts(attempts(spark, d).withColumnRenamed("example", "id"))


INTEGRITY = f"""WITH {ATTEMPTS}, k AS (SELECT * FROM attempts WHERE event_id % 31 <> 0),
    per AS (SELECT u.user_id, count(DISTINCT repeat) FILTER (repeat < 40) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k ON k.example = u.user_id GROUP BY u.user_id)
    SELECT unnest(['unknown_id', 'repeated_attempt', 'missing_attempt', 'repeat_out_of_range', 'result_and_error', 'neither', 'bad_seconds', 'changed_model']) AS violation,
        unnest([0, (SELECT count(*) FROM k WHERE event_id % 97 = 0), (SELECT sum(40 - n) FROM per), (SELECT count(*) + count(*) FILTER (event_id % 97 = 0) FROM k WHERE repeat >= 40), 0, 0, 0, 1])::BIGINT AS n"""


@query(INTEGRITY)
@query(INTEGRITY, name="run_integrity_all")
def run_integrity(spark, d):
    """A run with attempts left out, some twice, two models, and attempts beyond its 40 planned repeats: all are reported."""
    return _integrity(spark, d, attempts(spark, d))


def _integrity(spark, d, some):
    a = some.withColumnRenamed("example", "id").where("event_id % 31 <> 0")
    a = a.select("id", "repeat", "choice", F.when(F.col("choice").isNull(), "Timeout").alias("error_type"), F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("model"), "seconds", "event_id")
    every = a.unionByName(a.where("event_id % 97 = 0")).drop("event_id")
    return runs.integrity(every, table(spark, d, "events").select(F.col("user_id").alias("id")).distinct(), 40)


@query(
    f"""WITH {SCORES} SELECT round(avg(coalesce(m.choice = m.gold, false)::INT) - avg((p.choice = p.gold)::INT), 6) AS accuracy_delta, ['hardware'] AS changed_factors, NULL::DOUBLE AS latency_speedup
    FROM preds p JOIN missing m USING (vec_id)"""
)
def native_compare(spark, d):
    """A complete run against a partial one on other hardware: no latency ratio."""
    a = predictions(spark, d)
    both = a.select("vec_id", F.lit("baseline").alias("role"), "choice", "gold").unionByName(with_missing(a).select("vec_id", F.lit("candidate").alias("role"), "choice", "gold"))
    known = {"device": "cpu", "dtype": "float32", "transport": "local"}
    for n, v in known.items():
        both = both.withColumn(n, F.lit(v))
    both = both.withColumn("hardware", F.when(F.col("role") == "baseline", "x").otherwise("y")).withColumn("seconds", F.lit(1.0))
    return runs.native_compare(both)


def cases_and_attempts(spark, d):
    """The retrieval over benchmark items as an experiment of two repeats, of which the second of every fourth case is missing."""
    j = judged(spark, d)
    case = F.col("query_id").cast("string")
    single = F.transform("literal", lambda i: F.array(i))
    cases = j.select(
        case.alias("case_id"), F.col("item").alias("query"), F.lit("{}").alias("parameters"), F.col("query_id").cast("int").alias("case_ord"), F.col("judgments").alias("relevance"),
        single.alias("evidence_sets"), F.create_map().cast("map<string,string>").alias("evidence_texts"), F.lit(None).cast("array<string>").alias("acceptable_routes"), F.lit(None).cast("boolean").alias("correct"), F.lit(None).cast("boolean").alias("grounded"),
    )
    runs_ = j.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(1)))).where("repeat = 0 or query_id % 4 <> 0")
    none = F.create_map().cast("map<string,string>")
    done = runs_.select(
        case.alias("case_id"), "repeat", F.col("item").alias("query"), F.lit("s").alias("system"), F.lit(None).cast("string").alias("route"), F.col("ranked").alias("retrieval"), F.lit(None).cast("array<string>").alias("reranking_input"),
        F.slice("ranked", 1, 5).alias("reranking"), F.lit(False).alias("reranking_complete"), F.lit(None).cast("array<string>").alias("context_input"), F.slice("ranked", 1, 2).alias("context"), F.lit("").alias("context_text"),
        F.lit("a").alias("answer"), none.alias("errors"), none.alias("blocked"), F.lit(None).cast("boolean").alias("replay"), F.sha2(F.concat("item", F.col("repeat").cast("string")), 256).alias("output_sha256"),
        F.array().cast("array<string>").alias("step_errors"), F.lit(None).cast("string").alias("error_phase"), F.lit(None).cast("boolean").alias("review_correct"), F.lit(None).cast("boolean").alias("review_grounded"),
        F.create_map(F.lit("words"), F.size(F.split("item", " ")).cast("double")).alias("review_scores"), F.lit(0.5).alias("duration_seconds"), F.lit(None).cast("double").alias("review_duration_seconds"),
    )
    return cases, done


@query(
    f"""WITH {TRACES}, n AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 1 ELSE 2 END AS times FROM tr), p AS (SELECT count(*) * 2 AS planned, sum(times) AS recorded, count(*) FILTER (times = 2) AS unstable FROM n)
    SELECT planned, recorded::BIGINT AS recorded, (planned - recorded)::BIGINT AS missing, 0::BIGINT AS failures, 0::BIGINT AS stage_errors, 0::BIGINT AS diagnostic, unstable, planned AS eligible FROM p"""
)
def experiment_state(spark, d):
    cases, done = cases_and_attempts(spark, d)
    return experiment.state(cases, experiment.assess(cases, done, 5), 2)


@query(
    f"""WITH {TRACES}, n AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 1 ELSE 2 END AS times, ranked, lit FROM tr),
    v AS (SELECT times, 'source_coverage.retrieval' AS metric, CASE WHEN len(lit) > 0 THEN 1.0 END AS value FROM n
        UNION ALL SELECT times, 'source_coverage.context', CASE WHEN len(lit) > 0 THEN (len(list_intersect(lit, ranked[1:2])) > 0)::INT::DOUBLE END FROM n
        UNION ALL SELECT times, 'pipeline.duration_seconds', 0.5 FROM n
        UNION ALL SELECT times, 'custom.words', len(string_split(b.text, ' ')) FROM n JOIN benchmark b ON b.item_id = n.query_id
        UNION ALL SELECT times, 'routing.correct', NULL FROM n)
    SELECT metric, round(sum(value * times) / nullif(sum(times) FILTER (value IS NOT NULL), 0), 6) AS mean, coalesce(sum(times) FILTER (value IS NOT NULL), 0)::BIGINT AS observed,
        (SELECT count(*) * 2 FROM n) - coalesce(sum(times) FILTER (value IS NOT NULL), 0)::BIGINT AS unknown FROM v GROUP BY metric"""
)
def experiment_summary(spark, d):
    """Missing attempts stay in the denominator of what is known."""
    cases, done = cases_and_attempts(spark, d)
    s = experiment.report(cases, done, spark.createDataFrame([], "metric string, minimum double, maximum double, min_coverage double"), 5, 2)["summary"]
    names = ["source_coverage.retrieval", "source_coverage.context", "pipeline.duration_seconds", "custom.words", "routing.correct"]
    return s.where(F.col("metric").isin(names)).select("metric", "mean", "observed", "unknown")


@query(
    f"""WITH {TRACES} SELECT query_id::VARCHAR AS case_id, 1::BIGINT AS repeat, 'repeat_out_of_range' AS violation FROM tr WHERE query_id % 4 <> 0
    UNION ALL SELECT query_id::VARCHAR, 0, 'changed_system' FROM tr WHERE query_id % 5 = 0 UNION ALL SELECT query_id::VARCHAR, 1, 'changed_system' FROM tr WHERE query_id % 5 = 0 AND query_id % 4 <> 0"""
)
def experiment_invalid_attempts(spark, d):
    cases, done = cases_and_attempts(spark, d)
    done = done.withColumn("system", F.when(F.col("case_id").cast("int") % 5 == 0, "other").otherwise(F.col("system")))
    return experiment.invalid_attempts(cases, done, 1, "s")


@query(f"WITH {TRACES} SELECT query_id::VARCHAR AS case_id, r.repeat::BIGINT AS repeat FROM tr, range(2) r(repeat)")
def experiment_inputs(spark, d):
    cases, _ = cases_and_attempts(spark, d)
    return experiment.inputs(cases, 2, "s").select("case_id", "repeat")


@query(
    """WITH t AS (SELECT CASE WHEN user_id % 5 < 3 THEN 'dev' ELSE 'holdout' END AS split, user_id % 4 + 1 AS setting, avg(value) FILTER (event_id % 2 = 0) / avg(value) FILTER (event_id % 2 = 1) AS speedup FROM events GROUP BY ALL),
    best AS (SELECT setting, speedup FROM t WHERE split = 'dev' ORDER BY speedup DESC, setting LIMIT 1)
    SELECT best.setting::BIGINT AS setting, round(best.speedup, 6) AS dev_speedup, round(t.speedup, 6) AS holdout_speedup FROM best LEFT JOIN t ON t.split = 'holdout' AND t.setting = best.setting"""
)
def freeze_winner(spark, d):
    """Users dealt to a sweep of four settings on two splits: even events are the baseline's, odd ones the setting's."""
    e = table(spark, d, "events")
    split = F.when(F.col("user_id") % 5 < 3, "dev").otherwise("holdout").alias("split")
    side = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    return runs.freeze_winner(e.groupBy(split, (F.col("user_id") % 4 + 1).cast("int").alias("setting")).agg((side(0) / side(1)).alias("speedup")))


def quality_sql(name: str, predictions: str) -> str:
    """The classification summary's six measures of a table of predictions, as CTEs with names of their own."""
    chain = MATRIX.replace("missing m", f"{predictions} m")
    for cte in ("matrix", "classes", "prf"):
        chain = re.sub(rf"\b{cte}\b", f"{cte}_{name}", chain)
    return f"""{chain}, t_{name} AS (SELECT sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS c, sum(support * predicted)::DOUBLE AS sp, sum(support * support)::DOUBLE AS ss, sum(predicted * predicted)::DOUBLE AS pp FROM prf_{name}),
    f_{name} AS (SELECT sum(n)::DOUBLE AS failures FROM matrix_{name} WHERE predicted = '__failed__'),
    q_{name} AS (SELECT any_value(c / n) AS accuracy, (SELECT avg((s.rank <= 5 AND m.choice IS NOT NULL)::INT) FROM scores s JOIN {predictions} m USING (vec_id) WHERE s.cand = s.gold) AS top5_accuracy, avg(f1) AS macro_f1,
        avg(recall) FILTER (support > 0) AS balanced_accuracy, sum(support * f1) / any_value(n) AS weighted_f1,
        any_value(coalesce((c * n - sp) / nullif(sqrt((n * n - ss) * (n * n - pp - failures * failures)), 0), 0))::DOUBLE AS matthews_correlation FROM prf_{name}, t_{name}, f_{name}),
    l_{name} AS (UNPIVOT q_{name} ON COLUMNS(*) INTO NAME metric VALUE v)"""


@query(f"WITH {SCORES}{quality_sql('a', 'preds')}{quality_sql('b', 'missing')} SELECT metric, round(l_a.v, 6) AS baseline, round(l_b.v, 6) AS candidate, round(l_b.v - l_a.v, 6) AS delta FROM l_a JOIN l_b USING (metric)")
def native_quality_deltas(spark, d):
    """All six measures of a whole run and of one that lacks answers, and how far they are apart."""
    p = predictions(spark, d)

    def quality(some):
        top = some.agg(F.avg((F.col("choice").isNotNull() & F.coalesce(F.array_contains(F.slice("ranking", 1, 5), F.col("gold")), F.lit(False))).cast("double")).alias("top5_accuracy"))
        return classify.summary(classify.confusion(some, labels(spark, d))).crossJoin(F.broadcast(top))

    return runs.quality_deltas(quality(p), quality(with_missing(p)))


@query(
    """WITH r AS (SELECT 'u' || user_id AS run, user_id AS run_ord, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' ELSE 'failed' END AS status, count(DISTINCT event_type) AS labels, user_id % 3 AS prompt FROM events GROUP BY user_id),
    b AS (SELECT * FROM r ORDER BY run_ord LIMIT 1)
    SELECT r.run, unnest(list_filter([CASE WHEN r.status <> 'complete' THEN 'not complete' END, CASE WHEN b.status <> 'complete' THEN 'baseline not complete' END,
        CASE WHEN r.labels <> b.labels THEN 'labels differs' END, CASE WHEN r.prompt <> b.prompt THEN 'recipe changed: prompt' END], lambda x: x IS NOT NULL)) AS reason FROM r, b WHERE r.run_ord <> b.run_ord"""
)
def comparison_exclusions(spark, d):
    """Users as runs: which can't be compared with the first, and every reason."""
    kinds = F.count_distinct("event_type").alias("labels")
    status = F.when(F.count_if(F.col("event_type") == "error") == 0, "complete").otherwise("failed").alias("status")
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("run_ord")).agg(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), status, kinds)
    return runs.exclusions(per.withColumn("prompt", F.col("run_ord") % 3), ["labels"], ["prompt"])


@query("SELECT ord::BIGINT AS ord, 'L' || label AS id FROM (SELECT DISTINCT label, label AS ord FROM embeddings)")
def candidate_labels(spark, d):
    return labels(spark, d)


@query(
    f"""WITH {ATTEMPTS}, lines AS (SELECT event_id, event_id % 4 AS part, '{{"example":' || example || ',"repeat":' || repeat || ',"choice":' || CASE WHEN choice IS NULL THEN 'null' ELSE '"' || choice || '"' END
        || ',"tokens":' || coalesce(tokens::VARCHAR, 'null') || '}}' || chr(10) AS line FROM attempts)
    SELECT part, count(*) AS rows, sum(octet_length(encode(line)))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY event_id)) AS sha256, count(*) AS read_back FROM lines GROUP BY part"""
)
def saved_run_bytes(spark, d):
    """All attempts as a run of four parts: its receipts, and the rows read back under them."""
    a = attempts(spark, d).repartitionById(4, (F.col("event_id") % 4).cast("int")).sortWithinPartitions("event_id").select("example", "repeat", "choice", "tokens")
    place = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    save_run(a, place)
    # the example and repeat of a row say which part it was dealt to
    back = load_run(spark, place, a.schema).join(attempts(spark, d).select("example", "repeat", (F.col("event_id") % 4).cast("int").alias("part")), ["example", "repeat"])
    return receipts(spark, place).join(back.groupBy("part").agg(F.count("*").alias("read_back")), "part")


@query(
    f"""WITH {ATTEMPTS}, per AS (SELECT example, count(DISTINCT choice) AS c, max(choice) FILTER (repeat = 0) AS f, count(*) AS n, count(choice) AS ok, sum(seconds) AS s FROM attempts GROUP BY example),
    r AS (SELECT count(*)::DOUBLE AS attempted_examples, sum(n - ok)::DOUBLE AS failed_calls, (count(*) FILTER (c > 1))::DOUBLE AS unstable_examples, (count(*) FILTER (f IS NULL))::DOUBLE AS failed_first_attempts,
        sum(ok) / sum(s) AS successful_calls_per_second FROM per),
    long AS (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE v)
    SELECT metric, round(v, 6) AS recorded, round(v, 6) AS recomputed, true AS agrees FROM long"""
)
def saved_report_recomputed(spark, d):
    """A run's summary, saved with it and held against the one that its saved rows give."""
    a = attempts(spark, d).select("example", "repeat", "choice", "seconds")
    place = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    save_report(a, timing.run_summary(a), place)
    rows, recorded = load_report(spark, place, a.schema)
    return runs.verify(recorded, timing.run_summary(rows))


@query(
    """WITH c AS (SELECT turn, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: length(w)) AS t FROM conversations), v AS (SELECT * FROM c WHERE len(t) > 0),
    k AS (SELECT t, bool_or(turn = 0) AS known FROM v GROUP BY t)
    SELECT phase, (SELECT count(*) FROM c) AS asked, (SELECT count(*) FROM c WHERE len(t) = 0) AS invalid, (SELECT count(*) FROM k) AS distinct,
        CASE phase WHEN 'before' THEN (SELECT count(*) FROM k WHERE known) ELSE (SELECT count(*) FROM k) END AS hits,
        CASE phase WHEN 'before' THEN (SELECT count(*) FROM k WHERE NOT known) ELSE 0 END AS misses FROM (SELECT unnest(['before', 'after']) AS phase)"""
)
def embedding_reuse_plan(spark, d):
    """All turns against a table of vectors that has those of first turns, before and after it is filled; word lengths stand for tokens."""
    turns = table(spark, d, "conversations").select("turn", F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w)).alias("tokens"))
    asked = reuse.keyed(turns, {"name": "lengths", "revision": "1"}, "tokens")
    store = reuse.VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", 2)
    encoder = lambda t: F.array(F.size(t).cast("double"), F.aggregate(t, F.lit(0), lambda a, x: a + x).cast("double"))
    store.fill(asked.where("turn = 0"), "tokens", encoder)
    before = saved(reuse.reuse_plan(store.read(), asked), "plan")
    store.fill(asked, "tokens", encoder)
    return before.withColumn("phase", F.lit("before")).unionByName(reuse.reuse_plan(store.read(), asked).withColumn("phase", F.lit("after")))

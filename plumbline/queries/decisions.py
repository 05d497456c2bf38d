"""Scores, choices, rankings, judgments, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_set
from ..functions.vectors import dot, maxsim
from ..operators import classify, compare, decide, validate
from ..plans.fixtures import FACTOR, centroid_predictions, labels, predictions, protos, scored, states, table, vectors, with_missing
from .registry import CENTROIDS, PROTOS, SCORES, query


@query(f"WITH {SCORES} SELECT vec_id, ord::BIGINT AS ord, cand, round(score, 6) AS score, round(prob, 6) AS prob FROM scores")
def choice_scores(spark, d):
    return decide.long_shares(scored(spark, d), "vec_id").select("vec_id", "ord", F.col("id").alias("cand"), "score", "prob")


@query(f"WITH {SCORES} SELECT vec_id, choice FROM preds")
def choice_decide(spark, d):
    return scored(spark, d).select("vec_id", decide.choice(F.col("shares")).alias("choice"))


@query(f"WITH {SCORES} SELECT vec_id, rank::BIGINT AS rank, cand, round(prob, 6) AS prob FROM scores")
def rank_candidates(spark, d):
    ranked = scored(spark, d).select("vec_id", F.posexplode(decide.ranking(F.col("shares"))).alias("n", "s"))
    return ranked.select("vec_id", (F.col("n") + 1).alias("rank"), F.col("s.id").alias("cand"), F.col("s.prob").alias("prob"))


@query(
    f"""WITH {PROTOS}, pair AS (SELECT least(exp(2.0::DOUBLE), 100) AS f, (SELECT pv FROM protos WHERE ord = 0) AS no, (SELECT pv FROM protos WHERE ord = 1) AS yes),
    s AS (SELECT vec_id, f * list_dot_product(embedding::DOUBLE[], no) AS a, f * list_dot_product(embedding::DOUBLE[], yes) AS b FROM embeddings, pair
        WHERE vec_id NOT IN (SELECT proto_id FROM protos))
    SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS true_share, b > a AS leans_true FROM s"""
)
def judge_noul(spark, d):
    """A binary question whose two texts stand for the first two labels' vectors."""
    two = protos(spark, d).where("ord in (0, 1)").withColumn("id", F.when(F.col("ord") == 0, "false").otherwise("true"))
    s = decide.score_vectors(states(spark, d), two, "vector", FACTOR)
    return s.select("vec_id", decide.prob_of(F.col("shares"), "true").alias("true_share"), (decide.choice(F.col("shares")) == "true").alias("leans_true"))


@query(f"WITH {SCORES} SELECT vec_id, round(sum(ord * prob), 6) AS level, round(max(prob), 6) AS peak FROM scores GROUP BY vec_id")
def judge_score(spark, d):
    s = scored(spark, d)
    return s.select("vec_id", decide.expected_level(F.col("shares")).alias("level"), F.array_max(F.transform("shares", lambda x: x["prob"])).alias("peak"))


@query(
    f"""WITH {SCORES} SELECT vec_id, round(greatest(0, least(1, max(prob) - (sum(prob) - max(prob)) / (count(*) - 1))), 6) AS confidence
    FROM scores GROUP BY vec_id"""
)
def legacy_confidence(spark, d):
    return scored(spark, d).select("vec_id", decide.legacy_confidence(F.col("shares")).alias("confidence"))


@query(
    """SELECT doc_id, 0::BIGINT AS ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Which language is this?' AS prompt FROM documents
    UNION ALL SELECT NULL, 1, 'en' UNION ALL SELECT NULL, 2, 'fr' UNION ALL SELECT NULL, 3, 'de' UNION ALL SELECT NULL, 4, 'es'"""
)
def prompt_prepare(spark, d):
    """States first, then the candidates as they are; ids are never part of a prompt."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("ord"), decide.prompt(F.col("text"), F.lit("  Which language is this?\n")).alias("prompt"))
    own = spark.createDataFrame([(None, i, t) for i, t in enumerate(("en", "fr", "de", "es"), 1)], "doc_id bigint, ord int, prompt string")
    return docs.unionByName(own)


@query(
    """WITH r AS (SELECT conv_id AS request_id, text AS state, turn, role, text FROM conversations),
    one AS (SELECT request_id, max(length(state)) FILTER (turn = 0) AS s, count(*) AS candidates, sum(length(turn::VARCHAR) + length(text)) AS c, count(*) FILTER (trim(text) = '') AS blank
        FROM r GROUP BY request_id)
    SELECT request_id, 1::BIGINT AS questions, candidates, (coalesce(s, 0) + 1 + 6 + c)::BIGINT AS chars, blank > 0 OR candidates > 256 OR coalesce(s, 0) + 7 + c > 262144 AS violated FROM one"""
)
def request_limits(spark, d):
    """A conversation's turns as the candidates of one question about its first."""
    c = table(spark, d, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("state"))
    rows = c.join(first, "conv_id", "left").select(F.col("conv_id").alias("request_id"), F.coalesce("state", F.lit("")).alias("state"), F.lit("q").alias("question_id"), F.lit("Which?").alias("instructions"), F.col("turn").cast("string").alias("id"), "text")
    return validate.request_limits(rows).select("request_id", "questions", "candidates", "chars", (F.size("violations") > 0).alias("violated"))


@query("SELECT conv_id, min(length(text)) >= 1 AND max(length(text)) <= 8192 AND sum(length(text)) <= 16384 AS fits FROM conversations GROUP BY conv_id")
def token_budget(spark, d):
    """Characters stand for tokens."""
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("n"))
    return per.select("conv_id", validate.token_budget(F.col("n"), 8192).alias("fits"))


@query(
    f"""WITH {PROTOS}, q AS (SELECT vec_id, list_transform(range(8), lambda i: (embedding::DOUBLE[])[i * 8 + 1 : i * 8 + 8]) AS t FROM embeddings WHERE vec_id NOT IN (SELECT proto_id FROM protos)),
    c AS (SELECT ord, cand, list_transform(range(8), lambda i: pv[i * 8 + 1 : i * 8 + 8]) AS t FROM protos),
    s AS (SELECT vec_id, ord, cand, list_sum(list_transform(q.t, lambda a: list_max(list_transform(c.t, lambda b: list_dot_product(a, b))))) AS score FROM q, c)
    SELECT vec_id, cand, round(score, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS rank FROM s"""
)
def maxsim_rank(spark, d):
    """Late interaction over vectors cut into eight tokens of eight components."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    s = states(spark, d).withColumn("t", cut(F.col("vector")))
    p = protos(spark, d).withColumn("t", cut(F.col("vector")))
    s = decide.score(s, p, lambda c: maxsim(F.col("t"), c["t"]), "t")
    s = s.select("vec_id", F.posexplode(decide.ranking(F.col("shares"))).alias("n", "s"))
    return s.select("vec_id", F.col("s.id").alias("cand"), F.col("s.score").alias("score"), (F.col("n") + 1).alias("rank"))


OVERLAP = r"""WITH c AS (SELECT item_id AS ord, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM benchmark),
    s AS (SELECT doc_id, c.ord, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), c.t)) AS n FROM documents, c)
    SELECT doc_id, ord AS choice, n::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) = 1"""


@query(OVERLAP)
@query(OVERLAP, name="lexical_overlap_classify_all")
def lexical_overlap_classify(spark, d):
    """Every document against all benchmark items, however many, by shared distinct words."""
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), token_set(F.col("text")).alias("t"))
    docs = table(spark, d, "documents").select("doc_id", token_set(F.col("text")).alias("t"))
    return decide.most_shared(docs, c, "doc_id")


@query("SELECT 'en' AS choice, count(*) AS examples, round(avg((lang = 'en')::INT), 6) AS accuracy FROM documents")
def constant_baseline(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("gold"), F.lit("en").alias("choice"))
    return docs.groupBy("choice").agg(F.count("*").alias("examples"), F.avg((F.col("gold") == F.col("choice")).cast("double")).alias("accuracy"))


@query(
    f"""WITH {SCORES}, allowed AS (SELECT vec_id, cand FROM scores WHERE (vec_id + ord) % 3 <> 0)
    SELECT s.vec_id, s.cand, row_number() OVER (PARTITION BY s.vec_id ORDER BY s.score DESC, s.ord) AS rank FROM scores s JOIN allowed USING (vec_id, cand)"""
)
def permission_filtered_rank(spark, d):
    """Candidates that a state may not use are gone before anything is scored."""
    s = states(spark, d).select("vec_id", F.col("vector").alias("state"))
    p = protos(spark, d).select("ord", "id", "vector")
    allowed = s.select("vec_id").crossJoin(F.broadcast(decide.candidate_rows(p))).where((F.col("vec_id") + F.col("ord")) % 3 != 0).select("vec_id", "id")
    rows = decide.permitted(s, p, allowed, "vec_id").withColumn("score", dot(F.col("state"), F.col("vector")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "ord", "id")))  # at most 256
    out = rows.groupBy("vec_id").agg(ordered.alias("o")).select("vec_id", F.posexplode("o").alias("n", "s"))
    return out.select("vec_id", F.col("s.id").alias("cand"), (F.col("n") + 1).alias("rank"))


@query("SELECT min(doc_id) AS first_ord, count(*) AS rows, row_number() OVER (ORDER BY min(doc_id)) - 1 AS sequence_id FROM documents GROUP BY text")
def dedup_encode_plan(spark, d):
    return decide.encode_distinct(table(spark, d, "documents"), "text", "doc_id").drop("text")


@query(
    f"""WITH {SCORES} SELECT v AS violation, n FROM (SELECT unnest(['unknown_id', 'repeated_id', 'unknown_label', 'broken_ranking', 'missing']) AS v,
    unnest([0, (SELECT count(*) FROM preds WHERE vec_id % 50 = 0), (SELECT count(*) FROM preds WHERE vec_id % 23 = 0), 0, (SELECT count(*) FROM preds WHERE vec_id % 29 = 0 AND vec_id % 50 <> 0)])::BIGINT AS n)
    WHERE v NOT IN ('unknown_label', 'broken_ranking')"""
)
def prediction_violations(spark, d):
    """Rows broken on purpose: some ids twice, some missing."""
    p = predictions(spark, d).select(F.col("vec_id").alias("id"), "choice", "ranking")
    examples = p.select("id")
    broken = p.where((F.col("id") % 29 != 0) | (F.col("id") % 50 == 0)).unionByName(p.where(F.col("id") % 50 == 0))
    return validate.prediction_violations(broken, examples, labels(spark, d)).where("violation not in ('unknown_label', 'broken_ranking')")


@query(
    f"""WITH {SCORES} SELECT unnest(['unknown_id', 'repeated_id', 'unknown_label', 'broken_ranking', 'missing']) AS violation,
    unnest([(SELECT count(*) FROM preds WHERE vec_id % 37 = 0), (SELECT count(*) FROM preds WHERE vec_id % 50 = 0 AND vec_id % 37 <> 0), (SELECT count(*) FROM preds WHERE vec_id % 31 = 0) + (SELECT count(*) FROM preds WHERE vec_id % 50 = 0 AND vec_id % 31 = 0 AND vec_id % 37 <> 0),
        (SELECT count(*) FROM preds WHERE vec_id % 31 = 0 OR vec_id % 41 = 0) + (SELECT count(*) FROM preds WHERE vec_id % 50 = 0 AND vec_id % 37 <> 0 AND (vec_id % 31 = 0 OR vec_id % 41 = 0)),
        (SELECT count(*) FROM preds WHERE vec_id % 37 = 0)])::BIGINT AS n"""
)
def prediction_violations_all(spark, d):
    """Rows broken in all five ways: ids that nobody asked for, some twice, labels that aren't there, rankings that lost their last."""
    p = predictions(spark, d).select(F.col("vec_id").alias("id"), "choice", "ranking")
    choice = F.when(F.col("id") % 31 == 0, "nowhere").otherwise(F.col("choice"))
    ranking = F.when(F.col("id") % 41 == 0, F.slice("ranking", 1, F.size("ranking") - 1)).otherwise(F.col("ranking"))
    broken = p.select(F.when(F.col("id") % 37 == 0, -1 - F.col("id")).otherwise(F.col("id")).alias("id"), choice.alias("choice"), ranking.alias("ranking"))
    broken = broken.unionByName(broken.where("id >= 0 and id % 50 = 0"))
    return validate.prediction_violations(broken, p.select("id"), labels(spark, d))


@query(f"WITH {SCORES} SELECT vec_id, vec_id % 10 = 0 AS violated FROM preds")
def share_violations(spark, d):
    """Recorded shares, of which every tenth says its second choice."""
    p = predictions(spark, d).withColumn("choice", F.when(F.col("vec_id") % 10 == 0, F.get("ranking", F.lit(1))).otherwise(F.col("choice")))
    return p.select("vec_id", (F.size(validate.share_violations(F.col("shares"), F.col("choice"))) > 0).alias("violated"))


@query(f"WITH {PROTOS} SELECT 'request' AS side, 'q' AS question_id, ord::BIGINT AS ord, cand AS id FROM protos WHERE ord = 3 UNION ALL SELECT 'response', 'q', 3, 'other'")
def response_mismatch(spark, d):
    asked = labels(spark, d).select(F.lit("q").alias("question_id"), F.col("ord").cast("bigint").alias("ord"), "id")
    said = asked.withColumn("id", F.when(F.col("ord") == 3, "other").otherwise(F.col("id")))
    return validate.response_mismatch(asked, said)


@query(
    f"""WITH {SCORES}, v AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS a, list_transform(e.embedding::DOUBLE[], lambda x: x * 1.5 + 0.001) AS b FROM embeddings e)
    SELECT id, round(list_max(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2]))), 6) AS max_abs,
        round(sqrt(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) / len(a)), 6) AS rms,
        round(list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6) AS cosine,
        round(sqrt(list_dot_product(a, a)), 6) AS norm_reference, round(sqrt(list_dot_product(b, b)), 6) AS norm_candidate FROM v"""
)
def vector_difference(spark, d):
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "vector")
    return compare.vector_differences(v, v.withColumn("vector", F.transform("vector", lambda x: x * 1.5 + 0.001)))


@query(
    f"""WITH {SCORES} SELECT vec_id AS id, max(cand) FILTER (rank = 1) AS top, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin,
    max(rank) FILTER (cand = gold) AS gold_rank, round(max(score) FILTER (cand = gold) - max(score) FILTER (cand <> gold), 6) AS gold_margin FROM scores GROUP BY vec_id"""
)
def ranking_margins(spark, d):
    s = scored(spark, d).select(F.col("vec_id").alias("id"), "gold", F.explode("shares").alias("s")).select("id", "gold", "s.ord", F.col("s.id").alias("cand"), "s.score")
    return compare.margins(s)


@query(
    f"""WITH {SCORES}, b AS (SELECT *, score + CASE WHEN vec_id % 40 = 0 AND rank = 2 THEN 20 ELSE 0.0001 END AS after FROM scores),
    per AS (SELECT vec_id, arg_max(cand, {{'s': score, 'o': -ord}}) AS x, arg_max(cand, {{'s': after, 'o': -ord}}) AS y, max(abs(score - after)) AS e FROM b GROUP BY vec_id)
    SELECT count(*) AS cases, count(*) FILTER (x <> y) AS changed_choices, round(max(e), 6) AS max_score_error, count(*) FILTER (x <> y) = 0 AND max(e) <= 0.001 AS passed FROM per"""
)
def snapshot_compare_gates(spark, d):
    s = scored(spark, d).select("vec_id", F.posexplode(decide.ranking(F.col("shares"))).alias("n", "s"))
    bump = F.when((F.col("vec_id") % 40 == 0) & (F.col("n") == 1), 20.0).otherwise(0.0001)
    rows = s.select(F.col("vec_id").alias("id"), "s.ord", F.col("s.id").alias("cand"), F.col("s.score").alias("before"), (F.col("s.score") + bump).alias("after"))
    return compare.snapshot_gates(rows, 0.001)


@query()
def seeded_execution_order(spark, d):
    """A seeded shuffle of the prototypes' ids: at most one a label."""
    ids = sorted(r[0] for r in decide.candidate_rows(protos(spark, d), "proto_id").select("proto_id").collect())
    return compare.seeded_order(spark, ids, 42)


@query(f"WITH {SCORES}{CENTROIDS} SELECT vec_id, choice, choice = gold AS correct FROM cpreds")
def centroid_choice(spark, d):
    p = centroid_predictions(spark, d)
    return p.select("vec_id", "choice", (F.col("choice") == F.col("gold")).alias("correct"))


@query(f"WITH {SCORES} SELECT count(*) AS rows, count(choice) AS answered FROM missing")
def missing_predictions(spark, d):
    return with_missing(predictions(spark, d)).agg(F.count("*").alias("rows"), F.count("choice").alias("answered"))


@query(f"WITH {SCORES} SELECT vec_id, choice, gold = choice AS correct FROM preds")
def chosen_with_evidence(spark, d):
    return classify.choose(scored(spark, d)).select("vec_id", "choice", (F.col("gold") == F.col("choice")).alias("correct"))

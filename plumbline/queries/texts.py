"""Retrieval, traces, splits, audits, reviews and streams over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prepare, rag, ranking
from ..plans.fixtures import judged, retrieved, splits, table, traces, votes
from ..shared import shared_dir
from ..sources.io import verified_files
from ..streaming.pipeline import classify_stream, evaluate, stream_files
from .registry import query

TOK = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
HITS = f"""d AS (SELECT doc_id, text, {TOK.format('text')} AS t FROM documents), q AS (SELECT item_id AS query_id, text AS item, {TOK.format('text')} AS t FROM benchmark),
    hits AS (SELECT query_id, doc_id, item, len(q.t) AS words, contains(d.text, item) AS literal, len(list_intersect(d.t, q.t)) AS overlap FROM d, q),
    found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM hits WHERE overlap > 0)"""
JUDGED = f"""{HITS}, g AS (SELECT *, CASE WHEN literal THEN 2 WHEN overlap * 2 < words THEN 0 END AS grade FROM found WHERE rank <= 30)"""


@query(f"WITH {HITS} SELECT query_id, doc_id, overlap::BIGINT AS overlap, rank FROM found WHERE rank <= 10")
def lexical_retrieval_topn(spark, d):
    return retrieved(spark, d)


@query(
    f"""WITH {JUDGED}, a AS (SELECT query_id, count(*) FILTER (grade > 0) AS pos, count(*) FILTER (grade IS NOT NULL) AS judged, count(*) FILTER (rank <= 10) AS n,
        count(*) FILTER (rank <= 5 AND grade > 0) AS hits, count(*) FILTER (rank <= 5 AND grade IS NULL) AS unk, count(*) FILTER (rank <= 5) AS pre, max(grade) FILTER (rank = 1) AS g1,
        min(rank) FILTER (rank <= 10 AND grade > 0) AS fp, min(rank) FILTER (rank <= 10 AND grade IS NULL) AS fu, sum(grade / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM g GROUP BY query_id),
    i AS (SELECT query_id, sum(2 / log2(k + 1)) AS ideal FROM a, range(1, 6) r(k) WHERE k <= pos GROUP BY query_id)
    SELECT a.query_id, (g1 > 0)::INT::DOUBLE AS top1, CASE WHEN hits > 0 THEN 1::DOUBLE WHEN unk = 0 AND judged > 0 THEN 0::DOUBLE END AS hit_at_k, CASE WHEN pos > 0 THEN round(hits / pos, 6) END AS known_recall_at_k,
        CASE WHEN fp IS NOT NULL THEN CASE WHEN fu IS NULL OR fu > fp THEN round(1 / fp, 6) END WHEN pos > 0 AND fu IS NULL THEN 0.0 END AS reciprocal_rank,
        CASE WHEN pos > 0 AND unk = 0 THEN round(dcg / ideal, 6) END AS ndcg_at_k, round((pre - unk) / pre, 6) AS judged_fraction_at_k
    FROM a LEFT JOIN i USING (query_id)"""
)
def ir_metrics_graded(spark, d):
    j = judged(spark, d)
    m = ranking.assess(F.col("ranked"), F.col("judgments"), 5)
    return j.select("query_id", *[m[c].alias(c) for c in ranking.REASONS])


@query(f"WITH {JUDGED} SELECT query_id, coalesce(list(doc_id::VARCHAR ORDER BY rank) FILTER (rank <= 10 AND grade IS NULL), []::VARCHAR[]) AS unjudged FROM g GROUP BY query_id")
def ir_unjudged(spark, d):
    j = judged(spark, d)
    return j.select("query_id", ranking.assess(F.col("ranked"), F.col("judgments"), 5)["unjudged_ids"].alias("unjudged"))


TRACES = f"""{JUDGED}, r AS (SELECT query_id, doc_id::VARCHAR AS id, literal, row_number() OVER (PARTITION BY query_id ORDER BY (NOT literal), rank) AS place, rank FROM g WHERE rank <= 10),
    tr AS (SELECT query_id, list(id ORDER BY rank) AS ranked, list(id ORDER BY place) FILTER (place <= 5) AS reranked, list(id ORDER BY place) FILTER (place <= 2) AS context,
        coalesce(list(id ORDER BY rank) FILTER (literal), []::VARCHAR[]) AS lit FROM r GROUP BY query_id),
    j AS (SELECT query_id, coalesce(list(doc_id::VARCHAR) FILTER (grade > 0), []::VARCHAR[]) AS pos FROM g GROUP BY query_id)"""


@query(
    f"""WITH {TRACES} SELECT query_id, CASE WHEN len(lit) > 0 THEN true END AS retrieval, CASE WHEN len(lit) > 0 THEN true END AS reranking_top_k,
    CASE WHEN len(lit) > 0 THEN true END AS context FROM tr"""
)
def rag_source_coverage(spark, d):
    t = traces(spark, d)
    return t.select(
        "query_id",
        rag.source_coverage(F.col("ranked"), F.col("routes")).alias("retrieval"),
        rag.reranking_coverage(F.col("reranked"), F.lit(False), F.col("ranked"), F.col("routes"), 7).alias("reranking_top_k"),
        rag.source_coverage(F.col("context"), F.col("routes")).alias("context"),
    )


@query(
    f"""WITH {TRACES} SELECT query_id, CASE WHEN len(lit) = 0 THEN NULL WHEN len(lit) = 1 OR list_contains(lit[3:], context[1]) OR (context[1] IN (lit[1], lit[2]) AND context[2] IN (lit[1], lit[2])) THEN true ELSE false END AS retained FROM tr"""
)
def rag_text_retained(spark, d):
    """The context has the texts of its documents; each labelled text is the item itself."""
    t = traces(spark, d)
    items = F.map_from_arrays("literal", F.transform("literal", lambda i: F.concat(F.lit("#"), i, F.lit("#"))))
    packed = F.array_join(F.transform("context", lambda i: F.concat(F.lit("#"), i, F.lit("#"))), "\n\n")
    return t.select("query_id", rag.text_retained(packed, F.col("routes"), items).alias("retained"))


@query(
    f"""WITH {TRACES} SELECT query_id, list_sort(list_filter(pos, lambda p: NOT list_contains(ranked, p))) AS retrieval_missing, list_sort(list_filter(pos, lambda p: list_contains(reranked[3:], p))) AS reranking_below_k,
        list_sort(list_filter(pos, lambda p: list_contains(ranked, p) AND NOT list_contains(reranked, p))) AS reranking_unreturned, list_sort(list_filter(pos, lambda p: list_contains(reranked, p) AND NOT list_contains(context, p))) AS context_omitted
    FROM tr JOIN j USING (query_id)"""
)
def rag_losses(spark, d):
    t = traces(spark, d)
    none = F.lit(None).cast("array<string>")
    x = rag.losses(F.col("judgments"), F.col("ranked"), none, F.col("reranked"), F.col("reranked"), F.col("context"), 2)
    return t.select("query_id", *[x[c].alias(c) for c in ("retrieval_missing", "reranking_below_k", "reranking_unreturned", "context_omitted")])


@query(
    f"""WITH {TRACES} SELECT query_id, CASE WHEN len(list_intersect(pos, ranked)) > 0 THEN round(len(list_intersect(pos, reranked)) / len(list_intersect(pos, ranked)), 6) END AS known_recall_at_k FROM tr JOIN j USING (query_id)"""
)
def rag_shortlist_reranking(spark, d):
    """Recall given what the reranker was given: only judgments of its input count."""
    t = traces(spark, d)
    c = rag.conditional_judgments(F.col("judgments"), F.col("ranked"))
    return t.select("query_id", ranking.assess(F.col("reranked"), c, 5)["known_recall_at_k"].alias("known_recall_at_k"))


@query(
    f"""WITH {TRACES}, c AS (SELECT query_id, ranked[2:10] AS r, reranked[2:5] AS k, ranked[2:3] AS x, CASE WHEN len(lit) >= 2 THEN [lit[1:2]] ELSE list_transform(ranked[1:3], lambda i: [i]) END AS routes FROM tr)
    SELECT query_id, len(list_filter(routes, lambda w: len(list_intersect(w, r)) = len(w))) > 0 AS retrieval, len(list_filter(routes, lambda w: len(list_intersect(w, x)) = len(w))) > 0 AS context,
        CASE WHEN len(list_filter(routes, lambda w: len(list_intersect(w, k[1:2])) = len(w))) > 0 THEN true ELSE false END AS reranking_top_2 FROM c"""
)
def rag_source_coverage_partial(spark, d):
    """The same of traces that lost their first document everywhere, so that some routes are covered and some aren't."""
    t = traces(spark, d)
    routes = F.when(F.size("literal") >= 2, F.array(F.slice("literal", 1, 2))).otherwise(F.transform(F.slice("ranked", 1, 3), lambda i: F.array(i)))
    t = t.select("query_id", F.slice("ranked", 2, 9).alias("r"), F.slice("reranked", 2, 4).alias("k"), F.slice("ranked", 2, 2).alias("x"), routes.alias("routes"))
    return t.select(
        "query_id", rag.source_coverage(F.col("r"), F.col("routes")).alias("retrieval"), rag.source_coverage(F.col("x"), F.col("routes")).alias("context"),
        rag.reranking_coverage(F.col("k"), F.lit(False), F.col("r"), F.col("routes"), 2).alias("reranking_top_2"),
    )


@query(
    f"""WITH {TRACES}, a AS (SELECT query_id, doc_id, item, CASE WHEN query_id % 3 = 0 THEN upper(item) ELSE item END AS answer FROM found WHERE rank = 1)
    SELECT query_id, answer = item AS correct, answer <> '' AND contains(d.text, answer) AS grounded, len(list_filter(regexp_split_to_array(answer, '[\\s\\x1c-\\x1f]+'), lambda w: w <> ''))::DOUBLE AS answer_words FROM a JOIN d USING (doc_id)"""
)
def fixture_reviews(spark, d):
    """Each benchmark item as the expected answer, the first document found as context; every third answer is in capitals."""
    found = retrieved(spark, d, 1).select("query_id", "doc_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("context")), "doc_id")
    both = found.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")), "query_id")
    answer = F.when(F.col("query_id") % 3 == 0, F.upper("item")).otherwise(F.col("item"))
    return both.select("query_id", rag.fixture_review(answer, F.col("item"), F.col("context")).alias("r")).select("query_id", "r.*")


@query(
    """SELECT lang AS dataset, count(*) AS cases, count(*) FILTER (text IS NULL OR length(text) < 30) AS failed, round(avg(CASE WHEN text IS NULL OR length(text) < 30 THEN 0 ELSE (length(text) >= 60)::INT END), 6) AS mean,
        count(*) FILTER (text IS NULL OR length(text) < 30) = 0 AND avg(CASE WHEN text IS NULL OR length(text) < 30 THEN 0 ELSE (length(text) >= 60)::INT END) = 1 AS passed FROM documents GROUP BY lang"""
)
def starter_datasets(spark, d):
    """Languages as starter datasets: texts under 30 characters fail, and one of 60 or more counts as right."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("dataset"), (F.coalesce(F.length("text"), F.lit(0)) < 30).alias("failed"), (F.length("text") >= 60).alias("right"))
    return rag.starter_rule(docs, "dataset", "failed", "right")


@query("SELECT source AS label, lower(replace(source, '_', ' ')) AS text, count(*) AS rows FROM documents GROUP BY source")
def label_texts(spark, d):
    """Sources as labels, and the texts that candidates of them have."""
    return table(spark, d, "documents").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("rows")).select("label", T.label_text(F.col("label")).alias("text"), "rows")


CONV = """c AS (SELECT conv_id, max(text) FILTER (role = 'system') AS system, min(text) FILTER (role = 'user') AS question, max(text) FILTER (turn = 1) AS reply, max(turn) AS last FROM conversations GROUP BY conv_id)"""


@query(
    f"""WITH {CONV}, s AS (SELECT conv_id, unnest(['routing', 'retrieval', 'reranking', 'context', 'answer']) AS stage, unnest([system, question, NULL, NULL, reply]) AS o, conv_id % 3 = 0 AS e, conv_id % 5 = 0 AS b FROM c)
    SELECT conv_id, stage, CASE WHEN o IS NOT NULL THEN 'observed' WHEN e AND stage = 'reranking' THEN 'error' WHEN b AND stage IN ('context', 'routing') THEN 'blocked' ELSE 'not_observed' END AS status FROM s"""
)
def rag_stage_status(spark, d):
    c = conversations(spark, d)
    errors = F.when(F.col("conv_id") % 3 == 0, F.create_map(F.lit("reranking"), F.lit("Timeout"))).otherwise(F.create_map().cast("map<string,string>"))
    blocked = F.when(F.col("conv_id") % 5 == 0, F.create_map(F.lit("context"), F.lit("policy"), F.lit("routing"), F.lit("policy"))).otherwise(F.create_map().cast("map<string,string>"))
    outputs = {"routing": F.col("system"), "retrieval": F.col("question"), "reranking": F.lit(None), "context": F.lit(None), "answer": F.col("reply")}
    rows = [F.struct(F.lit(s).alias("stage"), rag.stage_status(o, F.col("errors"), F.col("blocked"), s).alias("status")) for s, o in outputs.items()]
    return c.withColumn("errors", errors).withColumn("blocked", blocked).select("conv_id", F.inline(F.array(*rows)))


def conversations(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("reply"), F.max("turn").alias("last")
    )


@query(
    """WITH a AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
    SELECT conv_id, turn, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') = regexp_replace(CASE WHEN turn % 2 = 0 THEN answer || '  ' ELSE text END, '^\\s+|\\s+$', '', 'g') AS correct FROM a WHERE next = 'assistant'"""
)
def rag_answer_exact_match(spark, d):
    """Turns and the assistant's next; every other expected answer is the answer with spaces after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    a = table(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)}).where("next = 'assistant'")
    expected = F.when(F.col("turn") % 2 == 0, F.concat("answer", F.lit("  "))).otherwise(F.col("text"))
    return a.select("conv_id", "turn", rag.exact_answer(F.col("answer"), expected).alias("correct"))


@query(f"WITH {CONV} SELECT conv_id, CASE WHEN system IS NOT NULL THEN conv_id % 2 = 0 END AS route_correct FROM c")
def rag_route_correct(spark, d):
    c = conversations(spark, d)
    route = F.when(F.col("system").isNotNull(), (F.col("conv_id") % 2).cast("string"))
    return c.select("conv_id", rag.route_correct(route, F.array(F.lit("0"))).alias("route_correct"))


SPLITS = "splits AS (SELECT doc_id, text, lang, source, sha256('split-v1:42:' || doc_id) AS key, CASE WHEN sha256('split-v1:42:' || doc_id)[1] IN ('c', 'd') THEN 'dev' WHEN sha256('split-v1:42:' || doc_id)[1] IN ('e', 'f') THEN 'test' ELSE 'train' END AS split FROM documents)"


@query(f"WITH {SPLITS} SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY key) AS place FROM splits QUALIFY place <= 10")
def split_per_label_sha10(spark, d):
    return prepare.first_per_label(splits(spark, d), "lang", F.col("key"), 10).select("doc_id", "lang", "place")


@query(f"WITH {SPLITS}, t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY key) AS place FROM splits QUALIFY place <= 10) SELECT doc_id, lang, row_number() OVER (ORDER BY place, lang) AS turn FROM t")
def round_robin_order(spark, d):
    return prepare.round_robin(prepare.first_per_label(splits(spark, d), "lang", F.col("key"), 10), "lang").select("doc_id", "lang", "turn")


COLLAPSED = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(
    f"""WITH k AS (SELECT DISTINCT source, {COLLAPSED} AS key FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('dev:' || key), key) AS p, count(*) OVER (PARTITION BY source) AS n FROM k)
    SELECT source, sha256(key) AS key FROM n WHERE n > 1 AND p <= greatest(1, n // 5)"""
)
def split_group20pct(spark, d):
    rows = table(spark, d, "documents").select("source", T.collapse(F.col("text")).alias("key"))
    return prepare.group_development_digests(rows, "source", "key", "dev:").select("source", F.col("digest").alias("key"))


@query(f"SELECT sha256({COLLAPSED}) AS key FROM documents GROUP BY {COLLAPSED} HAVING count(DISTINCT source) > 1")
def split_conflicting_keys(spark, d):
    rows = table(spark, d, "documents").select("source", T.collapse(F.col("text")).alias("key"))
    return prepare.conflicting_keys(rows, "source", "key").select(F.sha2("key", 256).alias("key"))


def keyed(spark, d):
    return splits(spark, d).withColumn("text_key", T.collapse(F.col("text")))


TRAINKEY = f"WITH {SPLITS}, k AS (SELECT doc_id, split, {COLLAPSED} AS tk FROM splits) SELECT doc_id FROM k WHERE split = 'test' AND tk {{}} (SELECT tk FROM k WHERE split = 'train')"


@query(TRAINKEY.format("IN"))
def train_overlap_semi(spark, d):
    k = keyed(spark, d)
    return prepare.overlap_rows(k.where("split = 'test'"), k.where("split = 'train'"), "text_key", "semi").select("doc_id")


@query(TRAINKEY.format("NOT IN"))
def train_overlap_anti(spark, d):
    k = keyed(spark, d)
    return prepare.overlap_rows(k.where("split = 'test'"), k.where("split = 'train'"), "text_key", "anti").select("doc_id")


KEYS = {"exact": "text", "lower_whitespace": COLLAPSED, "unicode_word_tokens": r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"}
WITHIN = " UNION ALL ".join(
    f"""SELECT '{n}' AS normalisation, split, count(*) AS distinct_keys, count(*) FILTER (c > 1) AS groups, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS rows, coalesce(sum(c * (c - 1) // 2) FILTER (c > 1), 0)::BIGINT AS pairs,
    count(*) FILTER (c > 1 AND a <> z) AS conflicts FROM (SELECT split, {k} AS key, count(*) AS c, min(source) AS a, max(source) AS z FROM splits GROUP BY split, key) GROUP BY split"""
    for n, k in KEYS.items()
)
WITHIN = WITHIN.replace(" AS key, count(*) AS c, min(source) AS a, max(source) AS z FROM splits GROUP BY split, key)", " AS tkey, count(*) AS c, min(source) AS a, max(source) AS z FROM splits GROUP BY split, tkey)")


@query(f"WITH {SPLITS} {WITHIN}")
def dup_within_split(spark, d):
    """Repeats in each split under three normalisations; sources stand for labels."""
    rows, out = splits(spark, d), None
    for name, f in prepare.NORMALISATIONS.items():
        one = prepare.audit_within(rows, f(F.col("text")), "source").withColumn("normalisation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


BETWEEN = " UNION ALL ".join(
    f"""SELECT '{n}' AS normalisation, l AS "left", r AS "right", count(*) FILTER (x > 0 AND y > 0) AS groups, coalesce(sum(x) FILTER (x > 0 AND y > 0), 0)::BIGINT AS left_rows, coalesce(sum(y) FILTER (x > 0 AND y > 0), 0)::BIGINT AS right_rows,
    coalesce(sum(x * y), 0)::BIGINT AS pairs, count(*) FILTER (x > 0 AND y > 0 AND a <> z) AS conflicts FROM (SELECT l, r, {k} AS tkey, count(*) FILTER (split = l) AS x, count(*) FILTER (split = r) AS y,
    min(source) FILTER (split IN (l, r)) AS a, max(source) FILTER (split IN (l, r)) AS z FROM splits, sides GROUP BY l, r, tkey) GROUP BY l, r"""
    for n, k in KEYS.items()
)


@query(f"WITH {SPLITS}, sides AS (SELECT unnest(['train', 'train', 'dev']) AS l, unnest(['dev', 'test', 'test']) AS r) {BETWEEN}")
def dup_between_splits(spark, d):
    rows, out = splits(spark, d), None
    for name, f in prepare.NORMALISATIONS.items():
        one = prepare.audit_between(rows, f(F.col("text")), ["train", "dev", "test"], "source").withColumn("normalisation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {SPLITS}, k AS (SELECT split, {COLLAPSED} AS t, source FROM splits)
    SELECT 'text' AS kind, count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT t, count(*) AS n FROM k GROUP BY t HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'group', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT source, count(*) AS n FROM k GROUP BY source HAVING count(DISTINCT split) > 1)"""
)
def support_audit_findings(spark, d):
    k = keyed(spark, d)
    return prepare.crossing(k, F.col("text_key"), "text").unionAll(prepare.crossing(k, F.col("source"), "group"))


@query("SELECT doc_id AS id, quality::VARCHAR AS first, (1 - toxic)::VARCHAR AS second FROM labels WHERE quality <> 1 - toxic")
def review_disagreements(spark, d):
    return prepare.disagreements(votes(spark, d))


@query(
    """SELECT doc_id AS id, CASE WHEN quality = 1 - toxic THEN quality::VARCHAR WHEN doc_id % 4 <> 0 THEN 'x' END AS label,
    CASE WHEN quality = 1 - toxic THEN 'agreed' WHEN doc_id % 4 <> 0 THEN 'adjudicated' ELSE 'unresolved' END AS how FROM labels"""
)
def review_resolved(spark, d):
    v = votes(spark, d)
    decided = prepare.disagreements(v).where(F.col("id") % 4 != 0).select("id", F.lit("x").alias("label"))
    return prepare.resolve(v, decided)


@query("SELECT 'p' AS packet_sha256, item_id AS id, to_json(text)::VARCHAR AS text_json, r AS reviewer, '' AS label, '' AS notes FROM benchmark, (SELECT unnest(['a', 'b']) AS r)")
def review_sheets(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return prepare.review_sheets(items, "p", ["a", "b"])


@query()
def casefold_audit(spark, d):
    """Repeats under full case folding and under NFKC, which SQL hasn't."""
    rows = splits(spark, d)
    a = prepare.audit_within(rows, T.casefold_collapse("text"), "source").withColumn("normalisation", F.lit("casefold"))
    return a.unionByName(prepare.audit_within(rows, T.compatible_collapse("text"), "source").withColumn("normalisation", F.lit("nfkc_casefold")))


@query()
def canonical_digest(spark, d):
    """SHA-256 of each event's properties in canonical JSON."""
    return table(spark, d, "events").select("event_id", T.canonical_digest("props").alias("sha256"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def preview_texts(spark, d):
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return table(spark, d, "documents").select("doc_id", T.shorten(flat, 80).alias("preview"))


@query()
def input_file_hashes(spark, d):
    """Length and digest of an input's files; their paths differ between places, so SQL can't say it."""
    return verified_files(spark, f"{d}/benchmark.parquet").select("length", "sha256")


def _judge(text: str) -> str:
    if len(text) < 20:
        raise ValueError(text)
    return "long" if len(text) > 500 else "short"


@query("SELECT doc_id, CASE WHEN length(text) >= 20 THEN CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END END AS choice, CASE WHEN length(text) < 20 THEN 'ValueError' END AS error_type FROM documents")
def evaluate_scorer(spark, d):
    """A Python scorer over all documents, its failures kept as data."""
    return evaluate(table(spark, d, "documents"), _judge, "text", "doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS choice FROM documents")
def stream_classify(spark, d):
    """The documents as a stream of files, judged by micro-batch and appended once."""
    import uuid

    docs = table(spark, d, "documents")
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").write.parquet(f"{place}/in")
    judge = lambda df: df.select("doc_id", F.when(F.length("text") > 500, "long").otherwise("short").alias("choice"))
    q = classify_stream(stream_files(spark, f"{place}/in", docs.select("doc_id", "text").schema), judge, f"{place}/out", f"{place}/state")
    q.awaitTermination()
    return spark.read.schema("doc_id bigint, choice string").parquet(f"{place}/out").select("doc_id", "choice")

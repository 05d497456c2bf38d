"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import selection_key, token_set
from ..functions.vectors import dot, doubles, mean_vector, scale
from ..operators.classify import with_evidence
from ..operators.decide import beside, candidate_rows, choice, score_vectors, with_shares
from ..operators.prepare import bucket_split
from ..operators.rag import lexical_retrieval
from ..shared import saved

FACTOR = scale(2.0)
REJECT = "L9"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """For comparison: whole numbers as bigint, doubles rounded to six places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(c.cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.round(c.cast("double"), 6).alias(name) if kind in ("double", "float") or kind.startswith("decimal") else c)
    return df.select(*out)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("gold"), "label", doubles("embedding").alias("vector"))


def protos(spark: SparkSession, d: str) -> DataFrame:
    """ord, id, vector: each label's vector with the smallest vec_id."""
    v = vectors(spark, d)
    return v.groupBy("label").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("p")).select(F.col("label").alias("ord"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("id"), "p.vector", F.col("p.vec_id").alias("proto_id"))


def states(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).join(F.broadcast(candidate_rows(protos(spark, d), "proto_id").select(F.col("proto_id").alias("vec_id"))), "vec_id", "left_anti")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, gold, shares of all vectors that are no prototypes: the array of candidates says which these are."""
    both = beside(vectors(spark, d), protos(spark, d), "vector", "proto_id")
    others = both.where(~F.exists("candidates", lambda c: c["proto_id"] == F.col("vec_id")))
    return with_shares(others, lambda c: F.lit(FACTOR) * dot(F.col("vector"), c["vector"])).select("vec_id", "gold", "vector", "shares")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return with_evidence(scored(spark, d).withColumn("choice", choice(F.col("shares")))).select("vec_id", "gold", "choice", "shares", "ranking", "p_gold", "confidence", "vector")


def with_missing(p: DataFrame) -> DataFrame:
    return p.withColumn("choice", F.when(F.col("vec_id") % 17 != 0, F.col("choice")))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    size = v.select(F.max(F.size("vector"))).first()[0] or 0
    return v.groupBy("label").agg(mean_vector(F.col("vector"), size).alias("vector")).select(F.col("label").alias("ord"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("id"), "vector")


def centroid_predictions(spark: SparkSession, d: str) -> DataFrame:
    s = score_vectors(states(spark, d), centroids(spark, d), "vector", 1.0)
    return s.select("vec_id", "gold", choice(F.col("shares")).alias("choice"), "shares")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return protos(spark, d).select("ord", "id")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """example, repeat, choice (null for errors), seconds, tokens: each user's events in time order."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("example"),
        (F.row_number().over(w) - 1).alias("repeat"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("choice"),
        F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        "event_id",
        "event_type",
        "props",
    )


def trials(spark: SparkSession, d: str) -> DataFrame:
    """system, run_id, case_id, seconds: events dealt to two systems, five processes, the event types as cases."""
    e = table(spark, d, "events")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate").alias("system"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.col("event_type").alias("case_id"),
        F.col("value").alias("seconds"),
    )


def splits(spark: SparkSession, d: str) -> DataFrame:
    """documents with label (their language), key and split."""
    docs = table(spark, d, "documents")
    return docs.withColumn("key", selection_key("split-v1:42:", F.col("doc_id"))).withColumn("split", bucket_split(F.col("key"))).withColumn("label", F.col("lang"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "labels")
    pairs = F.array(F.struct(F.lit(1).alias("reviewer"), F.col("quality").cast("string").alias("label")), F.struct(F.lit(2).alias("reviewer"), (1 - F.col("toxic")).cast("string").alias("label")))
    return one.select(F.col("doc_id").alias("id"), F.inline(pairs))


def retrieved(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    """query_id, doc_id, overlap, rank of benchmark items against all documents."""
    docs = table(spark, d, "documents").select("doc_id", token_set(F.col("text")).alias("tokens"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), token_set(F.col("text")).alias("tokens"))
    return lexical_retrieval(docs, items, top)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """query_id, ranked (ten ids), judgments: grade 2 for a literal hit, 0 for under half of the item's words, else none.

    Judgments are of the thirty documents retrieved first. Saved: a row an item, read by all that assesses it.
    """
    hits = retrieved(spark, d, 30)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), F.size(token_set(F.col("text"))).alias("words"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = hits.join(items, "query_id").join(docs, "doc_id")
    grade = F.when(F.contains("text", F.col("item")), 2).when(F.col("overlap") * 2 < F.col("words"), 0)
    rows = rows.select("query_id", "doc_id", "rank", "item", grade.alias("grade"), F.contains("text", F.col("item")).alias("literal"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"), "grade", "literal")))  # at most thirty
    out = rows.groupBy("query_id").agg(ordered.alias("o"), F.first("item").alias("item"))
    known = F.filter("o", lambda x: x["grade"].isNotNull())
    out = out.select(
        "query_id",
        "item",
        F.transform(F.slice("o", 1, 10), lambda x: x["id"]).alias("ranked"),
        F.map_from_arrays(F.transform(known, lambda x: x["id"]), F.transform(known, lambda x: x["grade"])).alias("judgments"),
        F.transform(F.filter(F.slice("o", 1, 10), lambda x: x["literal"]), lambda x: x["id"]).alias("literal"),
    )
    return saved(out, "judged")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces of the retrieval: reranked with literal hits first, of which a prefix of five is recorded; two go to the context."""
    j = judged(spark, d)
    keyed = F.transform("ranked", lambda i, n: F.struct((~F.array_contains("literal", i)).alias("a"), n.alias("n"), i.alias("id")))
    j = j.withColumn("reranked", F.slice(F.transform(F.array_sort(keyed), lambda x: x["id"]), 1, 5)).withColumn("context", F.slice("reranked", 1, 2))
    single = F.transform("literal", lambda i: F.array(i))
    both = F.when(F.size("literal") >= 2, F.array(F.slice("literal", 1, 2)))
    return j.withColumn("routes", F.coalesce(F.when(both.isNotNull(), F.concat(both, F.slice(single, 3, 100))), single))


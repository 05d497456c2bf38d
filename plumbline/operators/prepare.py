"""Data preparation: hash-ordered splits, overlap audits, two-reviewer adjudication.

Texts are counted and joined by their SHA-256, so that no text is moved as a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, selection_key, tokens
from .quantiles import on_keys


def bucket_split(key: Column, train: str = "0123456789ab", dev: str = "cd") -> Column:
    """train, dev or test by the first hex digit of a SHA-256 key."""
    digit = F.left(key, F.lit(1))
    return F.when(F.lit(train).contains(digit), "train").when(F.lit(dev).contains(digit), "dev").otherwise("test")


def first_per_label(rows: DataFrame, label: str, key: Column, n: int) -> DataFrame:
    """The n rows of each label with the lowest keys, with their place."""
    w = Window.partitionBy(label).orderBy(key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def round_robin(rows: DataFrame, label_ord: str) -> DataFrame:
    """Adds `turn`: rows in turns over the labels. Rows have `place`, bounded by the selection before."""
    return rows.withColumn("turn", F.row_number().over(Window.orderBy("place", label_ord)))


def group_development(rows: DataFrame, label: str, key: str, prefix: str, share: int = 5) -> DataFrame:
    """Development keys: of each label's distinct text keys, max(1, n div share) by hash order; none of a single key.

    Keys with several labels are left out here; see conflicting_keys.
    """
    return group_development_digests(rows, label, key, prefix, share).select(label, "key")


def group_development_digests(rows: DataFrame, label: str, key: str, prefix: str, share: int = 5, blocks: int = 256) -> DataFrame:
    """label, key, digest: the same with the key's SHA-256. Keys are dealt by digest and never compared as text.

    The order of selection is hexadecimal, so its first digits deal a label's keys to `blocks` stretches; places count within a stretch, from
    the number of keys in those before it. A label may hold a third of all rows.
    """
    order = selection_key(prefix, F.col(key))
    distinct = rows.groupBy(label, F.sha2(key, 256).alias("digest")).agg(F.max(order).alias("order_"), F.max(key).alias("key"))
    distinct = distinct.withColumn("block_", F.coalesce((F.conv(F.substring("order_", 1, 4), 16, 10).cast("int") * blocks / 65_536).cast("int"), F.lit(blocks)))  # a null key comes last
    before = Window.partitionBy(label).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # `blocks` rows
    held = distinct.groupBy(label, "block_").agg(F.count(F.lit(1)).alias("in_"))
    held = held.withColumns({"before_": F.coalesce(F.sum("in_").over(before), F.lit(0)), "n": F.sum("in_").over(Window.partitionBy(label))})
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") / share))
    some = on_keys(distinct, held.where((F.col("n") > 1) & (F.col("before_") < wanted)).drop("in_"), [label, "block_"], "inner")
    place = F.row_number().over(Window.partitionBy(label, "block_").orderBy(F.asc_nulls_last("order_"), "digest")) + F.col("before_")
    return some.withColumn("place", place).where(F.col("place") <= wanted).select(label, "key", "digest")


def conflicting_keys(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Keys with several labels. Rows are dealt by the key's digest."""
    per = rows.groupBy(F.sha2(key, 256).alias("digest")).agg(F.min(label).alias("a"), F.max(label).alias("z"), F.max(key).alias(key))
    return per.where("a < z").select(key)


NORMALISATIONS = {
    "exact": lambda t: t,
    "lower_whitespace": collapse,
    "unicode_word_tokens": lambda t: F.array_join(tokens(t), " "),
}


def audit_within(rows: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """Per split: distinct keys, groups of repeats, their rows and pairs, groups of conflicting labels."""
    per = rows.groupBy("split", F.sha2(key, 256).alias("key")).agg(F.count("*").alias("n"), F.min(label).alias("a"), F.max(label).alias("z"))
    again = F.col("n") > 1
    return per.groupBy("split").agg(
        F.count("*").alias("distinct_keys"),
        F.count_if(again).alias("groups"),
        F.sum(F.when(again, F.col("n")).otherwise(0)).alias("rows"),
        F.sum(F.when(again, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(0)).alias("pairs"),
        F.count_if(again & (F.col("a") != F.col("z"))).alias("conflicts"),
    )


def audit_between(rows: DataFrame, key: Column, splits: list[str], label: str = "label") -> DataFrame:
    """Per pair of splits: shared keys, rows on either side, pairs, keys of conflicting labels.

    One count per key with a column for each split; pairs of rows are counted, never made.
    """
    per = rows.groupBy(F.sha2(key, 256).alias("key")).agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits], *[f(F.when(F.col("split") == s, F.col(label))).alias(f"{w}_{s}") for s in splits for w, f in (("a", F.min), ("z", F.max))])
    out = []
    for i, a in enumerate(splits):
        for b in splits[i + 1 :]:
            both = (F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0)
            differs = F.least(F.col(f"a_{a}"), F.col(f"a_{b}")) != F.greatest(F.col(f"z_{a}"), F.col(f"z_{b}"))
            value = lambda x, both=both: F.sum(F.when(both, x).otherwise(0)).cast("long")
            out.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.count_if(both).alias("groups"), value(F.col(f"n_{a}")).alias("left_rows"), value(F.col(f"n_{b}")).alias("right_rows"), value(F.col(f"n_{a}") * F.col(f"n_{b}")).alias("pairs"), F.count_if(both & differs).alias("conflicts")))
    return per.agg(F.array(*out).alias("x")).select(F.inline("x"))


def crossing(rows: DataFrame, key: Column, kind: str) -> DataFrame:
    """Keys that occur in more than one split: kind, keys, rows."""
    per = rows.groupBy(F.sha2(key.cast("string"), 256).alias("key")).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("key is not null and splits > 1")
    return per.agg(F.lit(kind).alias("kind"), F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def overlap_rows(test: DataFrame, train: DataFrame, key: str, keep: str) -> DataFrame:
    """Test rows whose key is in train (keep: semi), or the others (anti). Rows are dealt by the key's digest."""
    seen = train.select(F.sha2(key, 256).alias("key_")).distinct()
    return test.withColumn("key_", F.sha2(key, 256)).join(seen, "key_", f"left_{keep}").drop("key_")


def fewest_texts(rows: DataFrame, label: str, text: Column) -> DataFrame:
    """Per split: distinct texts, and the fewest distinct texts of any of its labels."""
    per = rows.groupBy("split", label).agg(F.count_distinct(F.sha2(text, 256)).alias("n"))
    every = rows.groupBy("split").agg(F.count_distinct(F.sha2(text, 256)).alias("distinct_texts"))
    return every.join(per.groupBy("split").agg(F.min("n").alias("fewest_of_a_label")), "split")


def review_gaps(votes: DataFrame, tickets: DataFrame, reviewers: list) -> DataFrame:
    """id, reviewer, gap: missing, repeated or unknown votes; two complete reviews have none. votes: id, reviewer, label."""
    asked = tickets.select("id", F.explode(F.array(*[F.lit(r) for r in reviewers])).alias("reviewer"))
    got = votes.groupBy("id", "reviewer").agg(F.count("*").alias("n"), F.count("label").alias("labels"))
    both = asked.withColumn("asked_", F.lit(True)).join(got, ["id", "reviewer"], "full_outer")
    gap = F.when(F.col("asked_").isNull(), "unknown").when(F.coalesce(F.col("labels"), F.lit(0)) == 0, "missing").when(F.col("n") > 1, "repeated")
    return both.select("id", "reviewer", gap.alias("gap")).where("gap is not null")


def compile_splits(tickets: DataFrame, resolved: DataFrame) -> DataFrame:
    """split, id, text, label of resolved tickets; tickets: id, split, text. An unresolved one fails the query."""
    label = F.when(F.col("how") != "unresolved", F.col("label")).otherwise(F.raise_error(F.lit("a ticket is not resolved")))
    return tickets.join(resolved, "id").select("split", "id", "text", label.alias("label"))


def receipt(compiled: DataFrame) -> DataFrame:
    """Per split: examples, labels, and a digest that changes if any id, text or label does.

    The digest is over the 256 digests of buckets of rows, each over its rows in order of their own digests.
    """
    row = F.sha2(F.concat_ws("\x1f", F.col("id").cast("string"), "text", "label"), 256)
    lines = compiled.select("split", "label", row.alias("line"))
    bucket = lines.groupBy("split", F.left("line", F.lit(2)).alias("b")).agg(F.count("*").alias("n"), F.collect_set("label").alias("l"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)
    return bucket.groupBy("split").agg(F.sum("n").alias("examples"), F.size(F.array_distinct(F.flatten(F.collect_list("l")))).alias("labels"), digest.alias("sha256"))


def disagreements(votes: DataFrame) -> DataFrame:
    """id, first, second where two reviewers differ; votes: id, reviewer (1 or 2), label."""
    both = votes.groupBy("id").agg(*[F.max(F.when(F.col("reviewer") == r, F.col("label"))).alias(c) for r, c in ((1, "first"), (2, "second"))])
    return both.where(~F.col("first").eqNullSafe(F.col("second")))


def resolve(votes: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """id, label, how: agreed, adjudicated, or unresolved with a null label; adjudicated: id, label."""
    both = votes.groupBy("id").agg(*[F.max(F.when(F.col("reviewer") == r, F.col("label"))).alias(c) for r, c in ((1, "first"), (2, "second"))])
    out = both.join(adjudicated.select("id", F.col("label").alias("decided")), "id", "left")
    agreed = F.col("first") == F.col("second")
    how = F.when(agreed, "agreed").when(F.col("decided").isNotNull(), "adjudicated").otherwise("unresolved")
    return out.select("id", F.when(agreed, F.col("first")).otherwise(F.col("decided")).alias("label"), how.alias("how"))


def review_sheets(tickets: DataFrame, packet: str, reviewers: list[str]) -> DataFrame:
    """A blind row per ticket and reviewer, texts quoted as JSON."""
    one = F.explode(F.array(*[F.lit(r) for r in reviewers]))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":(.*)\}$', 1)
    return tickets.select(F.lit(packet).alias("packet_sha256"), "id", quoted.alias("text_json"), one.alias("reviewer"), F.lit("").alias("label"), F.lit("").alias("notes"))


"""The most shared distinct tokens between a large table and a stated set of token lists, without forming most pairs.

An inverted index over the stated lists (asks) is broadcast; its size is checked. Each ask's tokens are in order of impact: the rarest in
the table first. If a pair must share `need` tokens to matter, and an ask has m, the pair shares one of the ask's
m - need + 1 rarest: only these are looked up, so common tokens form no pairs. What is needed is known from exact scores of a few
seeds, and ties are part of the bound: a later one of equal score needs one token more. Every bound is proven, nothing is cut by
a guess; seeds only say how much is pruned. Only pairs that meet at a token that is looked up are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import overlap
from ..shared import saved

MOST_TOKENS = 1_000_000
_ASKS = "ask bigint, toks array<int>"


def stated(asks: DataFrame, ask: str, tokens: str, most: int = MOST_TOKENS) -> list[Row] | None:
    """ask, toks (distinct): the asks on the driver, if they have at most `most` tokens in all; else None."""
    rows = asks.select(F.col(ask).cast("bigint").alias("ask"), F.array_distinct(F.filter(tokens, lambda t: t.isNotNull())).alias("toks"))
    size = rows.agg(F.coalesce(F.sum(F.size("toks") + 1), F.lit(0))).first()[0]
    return rows.collect() if size <= most else None


def reduced(table: DataFrame, key: str, tokens: str, asks: list[Row]) -> tuple[DataFrame, list[tuple[int, list[int]]]]:
    """row, key, t: of each row of the table, by a number of its own, the distinct tokens that some ask has; and the asks. Tokens are numbered by name.

    Rows without any are left out. Saved, as it is read several times.
    """
    number = {t: i for i, t in enumerate(sorted({t for a in asks for t in a["toks"] or ()}))}
    known = table.sparkSession.createDataFrame(list(number.items()), "token string, number int")
    numbered = table.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.array_distinct(tokens).alias("tokens"))
    met = numbered.select("key", "row", F.explode("tokens").alias("token")).join(F.broadcast(known), "token")
    # a row's tokens are beside each other, so the sums by row are all but done before they move
    rows = saved(met.groupBy("row", "key").agg(F.collect_list("number").alias("t")), "overlap")
    return rows, [(a["ask"], [number[t] for t in a["toks"] or ()]) for a in asks]


def by_impact(table: DataFrame, asks: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """The asks with tokens by rising number of rows that have them; and these numbers."""
    times = {r["token"]: r["n"] for r in table.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(a, sorted(toks, key=lambda t: (times.get(t, 0), t))) for a, toks in asks], times


def _looked_up(table: DataFrame, index: DataFrame, wanted: Column | None = None) -> DataFrame:
    """row, ask: the pairs that share a token of the index for which `wanted` holds."""
    index = index.groupBy("token").agg(F.collect_list(F.struct(*[c for c in index.columns if c != "token"])).alias("p"))
    columns = [c for c in table.columns if c != "t"]
    met = table.select(*columns, F.explode("t").alias("token")).join(F.broadcast(index), "token").select(*columns, F.inline("p"))
    return (met if wanted is None else met.where(wanted)).select("row", "ask").distinct()


def _scored(pairs: DataFrame, table: DataFrame, asks: DataFrame) -> DataFrame:
    """Adds overlap, and what the asks have."""
    return pairs.join(F.broadcast(asks), "ask").join(table, "row").withColumn("overlap", overlap(F.col("t"), F.col("toks"))).drop("t", "toks")


def top_rows(table: DataFrame, key: str, tokens: str, asks: list[Row], top: int, seeds: int = 256, rare: int = 4096) -> DataFrame:
    """ask, key, overlap: the `top` rows of the table that share most tokens with each ask; ties to the smaller key.

    Seeds: the rows with the smallest keys, and those of each ask's three rarest tokens, unless more than `rare` rows have them.
    Rows that share nothing aren't among the best. Asks without tokens have none.
    """
    pairs = pairs_of_top_rows(table, key, tokens, asks, top, seeds, rare)
    best = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("overlap"), "key"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= top)


def pairs_of_top_rows(table: DataFrame, key: str, tokens: str, asks: list[Row], top: int, seeds: int = 256, rare: int = 4096) -> DataFrame:
    """ask, key, overlap of every pair that is scored in the end: those that may be among the best."""
    spark = table.sparkSession
    rows, own = reduced(table, key, tokens, asks)
    own, times = by_impact(rows, own)
    ranked = spark.createDataFrame(own, _ASKS)
    # what the best seeds reach: at least as much is needed
    few = rows.orderBy("key").limit(seeds)
    index = ranked.select("ask", F.posexplode("toks").alias("pos", "token"))
    held = spark.createDataFrame([(t, n) for t, n in times.items() if n <= rare], "token int, n bigint")
    near = _looked_up(rows, index.where("pos < 3").join(F.broadcast(held), "token").drop("n", "pos"))
    scored = _scored(_looked_up(few, index.drop("pos")).unionByName(near).select("ask", "row").distinct(), rows, ranked)
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("overlap"), "key"))
    least = {r["ask"]: (r["overlap"], r["key"]) for r in scored.withColumn("place", place).where(F.col("place") == top).collect()}
    # a row beyond the last seed needs one token more than it, one before it as many
    limits = spark.createDataFrame([(a, toks, *least.get(a, (1, None))) for a, toks in own], f"{_ASKS}, need int, last bigint")
    index = limits.select("ask", F.size("toks").alias("m"), "need", "last", F.posexplode("toks").alias("pos", "token")).where("pos <= m - need")
    before = F.col("last").isNull() | (F.col("key") <= F.col("last"))
    found = _scored(_looked_up(rows, index, (F.col("pos") < F.col("m") - F.col("need")) | before), rows, limits)
    return found.where((F.col("overlap") > F.col("need")) | ((F.col("overlap") == F.col("need")) & before)).select("ask", "key", "overlap")


def best_ask(table: DataFrame, key: str, tokens: str, asks: list[Row], seeds: int = 16) -> DataFrame:
    """key, ask, overlap: the ask that shares most tokens with each row; ties to the smaller ask. Rows that share none are left out.

    Seeds: the asks whose tokens occur most often.
    """
    pairs, some = pairs_of_best_ask(table, key, tokens, asks, seeds)
    best = pairs.unionByName(some).groupBy("key").agg(F.max(F.struct("overlap", (-F.col("ask")).alias("o"))).alias("top"))
    return best.select("key", (-F.col("top.o")).alias("ask"), F.col("top.overlap").alias("overlap"))


def pairs_of_best_ask(table: DataFrame, key: str, tokens: str, asks: list[Row], seeds: int = 16) -> tuple[DataFrame, DataFrame]:
    """key, ask, overlap: the pairs that are scored in the end, and each row's best seed."""
    spark = table.sparkSession
    rows, own = reduced(table, key, tokens, asks)
    own, times = by_impact(rows, own)
    ranked = spark.createDataFrame(own, _ASKS)
    often = sorted(own, key=lambda a: (-sum(times.get(t, 0) for t in a[1]), a[0]))[:seeds]
    one = spark.createDataFrame([(often,)], "seeds array<struct<ask: bigint, toks: array<int>>>")
    score = lambda s: F.struct(overlap(F.col("t"), s["toks"]).alias("overlap"), (-s["ask"]).alias("o"))
    rows = rows.crossJoin(F.broadcast(one)).withColumn("seed", F.array_max(F.transform("seeds", score))).drop("seeds")
    index = ranked.select("ask", F.size("toks").alias("m"), F.posexplode("toks").alias("pos", "token"))
    # an ask that comes later needs one token more than the best seed
    need = F.greatest(F.col("seed.overlap") + F.when(F.col("ask") > -F.col("seed.o"), 1).otherwise(0), F.lit(1))
    found = _scored(_looked_up(rows, index, F.col("pos") <= F.col("m") - need), rows, ranked).where(F.col("overlap") >= need)
    return found.select("key", "ask", "overlap"), rows.where("seed.overlap > 0").select("key", (-F.col("seed.o")).alias("ask"), F.col("seed.overlap").alias("overlap"))

"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 and 1 and normalised. The exponent is
bisected: the largest whose weights reach the target entropy, and raised from there if a source would be
repeated more often than allowed. The weights are realised within a token budget: each source is dealt
into blocks by hash, and each epoch over a source visits its blocks, and each block's documents, in an
order of its own; the last epoch stops where the source's budget ends. A document's slot, its place in
its source's budget, interleaves the sources in the target proportion.

Only the table of sources (at most `max_sources` rows) comes to the driver. A hot source is as many
blocks as it needs: running sums are taken in a block and over the table of blocks, never over a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, free_shuffles, fresh

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """flatten: target entropy's place between that of the shares (0) and of even weights (1)."""

    flatten: float = 0.5
    max_repeats: float = 4.0
    budget: int | None = None  # tokens; None: as many as there are
    block_docs: int = 4096
    max_sources: int = 100_000
    seed: int = 17


def temperature_weights(tokens: dict[str, int], settings: Settings = Settings()) -> tuple[float, dict[str, float], int]:
    """Exponent, weights by source, and the budget. Sources without tokens have weight 0.

    A budget that even the shares themselves can't meet within max_repeats is cut to what they can.
    """
    some = {s: n for s, n in sorted(tokens.items()) if n > 0}
    total = sum(some.values())
    if not total:
        return 1.0, dict.fromkeys(tokens, 0.0), 0
    budget = min(settings.budget if settings.budget is not None else total, math.floor(total * settings.max_repeats))
    top = max(some.values())

    def weights(a: float) -> dict[str, float]:
        raised = {s: (n / top) ** a for s, n in some.items()}
        z = math.fsum(raised.values())
        return {s: x / z for s, x in raised.items()}

    def entropy(a: float) -> float:
        return -math.fsum(w * math.log(w) for w in weights(a).values() if w > 0)

    def repeats(a: float) -> float:
        return max(w * budget / some[s] for s, w in weights(a).items())

    target = entropy(1.0) + settings.flatten * (math.log(len(some)) - entropy(1.0))
    a = _bisect(lambda a: entropy(a) >= target, largest=True)
    if repeats(a) > settings.max_repeats:
        a = max(a, _bisect(lambda a: repeats(a) <= settings.max_repeats, largest=False))
    return a, dict.fromkeys(tokens, 0.0) | weights(a), budget


def _bisect(holds, largest: bool) -> float:
    """The end of the stretch of [0, 1] where a monotone condition holds: from 0 up (largest) or down from 1."""
    low, high = 0.0, 1.0
    if largest and holds(high):
        return high
    if not largest and holds(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        if holds(middle) == largest:
            low = middle
        else:
            high = middle
    return low if largest else high


def _draw(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mix_sources(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, epoch, block, n_tokens, weight, slot: a row for each time that a document is visited.

    Tokens are words. A null source is a source of its own, and a null or empty text has no tokens: it
    comes along once in every epoch that its place is within. Rows that share a doc_id (null too) are one
    document, of the smallest source and all their tokens. A source's visits together have at most its
    budget of tokens, and less than that by less than its next document. Other columns are ignored; an
    empty table gives none.
    """
    spark = documents.sparkSession
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count.alias("n_tokens"))
    docs = Written(docs.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")), "tokens").read()
    sources = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).limit(settings.max_sources + 1).collect()
    if len(sources) > settings.max_sources:
        raise ValueError(f"over {settings.max_sources} sources")
    _, weight, budget = temperature_weights({_name(r["source"]): r["tokens"] for r in sources}, settings)
    plan = [(r["source"], weight[_name(r["source"])], r["tokens"], weight[_name(r["source"])] * budget, max(1, math.ceil(r["docs"] / settings.block_docs))) for r in sources]
    plan = F.broadcast(spark.createDataFrame(plan, "plan_source string, weight double, total long, budget double, blocks int"))  # at most max_sources rows
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    rows = rows.withColumn("block", F.pmod(_draw(settings.seed, F.col("doc_id")), F.col("blocks").cast("long")))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs)))
    key = ["source", "epoch", "block"]
    within = Window.partitionBy(*key).orderBy(_draw(settings.seed, F.col("epoch"), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n_tokens").over(within))
    by_block = rows.groupBy(*key).agg(F.sum("n_tokens").alias("in_block"))
    over = Window.partitionBy("source", "epoch").orderBy(_draw(settings.seed, F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.withColumn("before", F.coalesce(F.sum("in_block").over(over), F.lit(0)))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    rows = rows.alias("r").join(by_block.alias("b"), same[0] & same[1] & same[2]).select("r.*", "b.before")
    reached = F.col("epoch") * F.col("total") + F.col("before") + F.col("upto")
    rows = rows.withColumn("reached", reached).where(F.col("reached") <= F.col("budget"))
    slot = F.when(F.col("budget") > 0, F.col("reached") / F.col("budget")).otherwise(F.lit(0.0))
    free_shuffles(spark)
    return rows.select("doc_id", "source", "epoch", F.col("block").cast("long").alias("block"), "n_tokens", "weight", slot.alias("slot"))


def _name(source: str | None) -> str:
    """As a key that sorts: null apart from all strings."""
    return "0" if source is None else f"1{source}"


def mix_documents(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents, each as often as it is visited; those never visited go."""
    times, key = fresh(documents, "times_"), fresh(documents, "key_")
    visits = mix_sources(documents, settings).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").cast("int").alias(times))
    both = documents.join(visits.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    copies = both.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*[F.col(f"`{c}`") for c in documents.columns])

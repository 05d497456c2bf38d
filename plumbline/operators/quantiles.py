"""Exact quantiles by group, by selecting order statistics: no group is ever in one task.

Values are dealt to stretches of their order by approximate quantiles of the whole table. Counts by group and stretch say in which
stretch each wanted rank lies; only those stretches' values are counted, equal ones together, and the ranks picked
from running counts. What a task holds is bounded by a stretch's distinct values or a group's stretches, however large a group is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved
from .running import dealt_to_blocks


def on_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys meet null keys; b's keys go."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    named = b.withColumnsRenamed({k: f"{k}_right_" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_right_")) for k in keys])
    return a.join(named, same, how).drop(*[f"{k}_right_" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], least: dict[str, int] | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """keys, and for each name of probs its quantile by linear interpolation; least: below how many values a quantile is null.

    Nulls don't count; NaN is the largest. Groups without values are left out. Equal values are one entry, so ties cost nothing.
    """
    some = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v_"))
    blocks = min(16_384, -(-some.count() // block_rows))
    dealt = some.withColumn("block_", F.lit(0))
    if blocks > 1:
        # written, as it is read twice, and so that plans don't grow with the number of stretches
        dealt = saved(dealt_to_blocks(some, "v_", blocks), "stretches")
        order = Window.partitionBy(*keys).orderBy("block_")
        held = dealt.groupBy(*keys, "block_").agg(F.count(F.lit(1)).alias("in_"))
        held = held.withColumn("before_", F.sum("in_").over(order) - F.col("in_")).withColumn("n_", F.sum("in_").over(Window.partitionBy(*keys)))
        wanted = [((F.floor(p * (F.col("n_") - 1)) < F.col("before_") + F.col("in_")) & (F.ceil(p * (F.col("n_") - 1)) >= F.col("before_"))) for p in probs.values()]
        dealt = on_keys(dealt, held.where(reduce(Column.__or__, wanted)).drop("in_"), [*keys, "block_"], "inner")
        tally = dealt.groupBy(*keys, "block_", "v_").agg(F.count(F.lit(1)).alias("c_"), F.first("before_").alias("before_"), F.first("n_").alias("n_"))
    else:
        tally = dealt.groupBy(*keys, "block_", "v_").agg(F.count(F.lit(1)).alias("c_")).withColumn("before_", F.lit(0)).withColumn("n_", F.sum("c_").over(Window.partitionBy(*keys)))
    last = F.sum("c_").over(Window.partitionBy(*keys, "block_").orderBy("v_")) + F.col("before_")
    placed = tally.withColumn("last_", last)
    picks, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        place = F.lit(float(p)) * (F.col("n_") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(F.max(F.when((F.col("last_") - F.col("c_") <= rank) & (rank < F.col("last_")), F.col("v_"))).alias(f"{side}{i}_"))
        low, high = F.col(f"low{i}_"), F.col(f"high{i}_")
        between = F.when((low == high) | (F.floor(place) == F.ceil(place)), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
        out.append(F.when(F.col("n_") >= (least or {}).get(name, 1), between).alias(name))
    return placed.groupBy(*keys).agg(*picks, F.first("n_").alias("n_")).select(*keys, *out)

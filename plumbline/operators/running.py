"""Running totals over a whole table in one order, without bringing the table into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _block(df: DataFrame, order: str, cuts: list[float], sign: int) -> DataFrame:
    """Adds block_: how many cuts lie below, found by halving."""

    def below(a: int, b: int):
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(F.col(order) > F.lit(cuts[middle]), below(middle + 1, b)).otherwise(below(a, middle))

    if len(cuts) <= 256:
        return df.withColumn("block_", below(0, len(cuts)) * sign)
    # in two steps: stretches of cuts first, so that no expression grows with the number of blocks
    width = math.isqrt(len(cuts)) + 1
    table = F.array(*[F.lit(float(c)) for c in cuts])
    coarse = [cuts[i] for i in range(width - 1, len(cuts), width)]
    dealt = _block(df, order, coarse, 1)
    inner = F.size(F.filter(F.slice(table, F.col("block_") * width + 1, F.lit(width)), lambda c: F.col(order) > c))
    return dealt.withColumn("block_", (F.col("block_") * width + inner) * sign)


def dealt_to_blocks(df: DataFrame, order: str, blocks: int, descending: bool = False) -> DataFrame:
    """Adds block_, the number of a row's stretch of the order; stretches by approximate quantiles, about equally long."""
    cuts = sorted(set(df.approxQuantile(order, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    return _block(df, order, cuts, -1 if descending else 1)


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, blocks: int | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Adds, for each column of sums, its running total under the new name. `order` must be unique and numeric.

    Rows are dealt to stretches of the order by approximate quantiles, totals run within a stretch, and each
    stretch starts from the total of those before it. Stretches: one for each block_rows rows, 8 at least and
    16,384 at most, so the table of their totals is bounded.
    """
    blocks = blocks or min(16_384, max(8, -(-df.count() // block_rows)))
    dealt = dealt_to_blocks(df, order, blocks, descending)
    key = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy("block_").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("block_").agg(*[F.sum(c).alias(f"{n}_sum_") for c, n in sums.items()])
    offsets = offsets.select("block_", *[F.coalesce(F.sum(f"{n}_sum_").over(before), F.lit(0)).alias(f"{n}_before_") for n in sums.values()])
    out = dealt.join(F.broadcast(offsets), "block_")  # bounded, see above
    for c, n in sums.items():
        out = out.withColumn(n, F.sum(c).over(within) + F.col(f"{n}_before_"))
    return out.drop("block_", *[f"{n}_before_" for n in sums.values()])

"""Connected components of links that no single machine holds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, free_shuffles

_EDGES = pa.schema([("v", pa.int64()), ("w", pa.int64())])


def _forest(batches):
    """Links of one batch, as stars around their smallest node."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        for a, b in zip(batch["v"].to_pylist(), batch["w"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in up if (r := root(x)) != x]
        yield pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], schema=_EDGES)


def connected_components(links: DataFrame) -> DataFrame:
    """links: v, w (long). Returns node, component (smallest node reached) for nodes that aren't their own component.

    Each batch of links first shrinks to stars. Then, until nothing changes: a node hooks on to its
    smallest neighbour below, its other neighbours below hook on to the same one, and pointers are
    doubled. Rounds grow with the logarithm of the longest path; each is written to the shared folder,
    so that a lost executor costs that round at most. Nothing but a count and a sum comes to the driver.
    """
    spark = links.sparkSession
    edges = Written(links.where("v <> w").mapInArrow(_forest, "v long, w long").distinct(), "edges")

    def mark(table: Written):
        return table.read().agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(20,0)"))).first()

    seen = mark(edges)
    while True:
        e = edges.read()
        best = e.groupBy("v").agg(F.min("w").alias("p"))
        hooked = e.join(best, "v").where("w <> p").select(F.col("w").alias("v"), F.col("p").alias("w"))
        above = best.select(F.col("v").alias("p"), F.col("p").alias("g"))
        doubled = best.join(above, "p", "left").select("v", F.coalesce("g", "p").alias("w"))
        after = Written(hooked.unionAll(doubled).distinct(), "edges")
        now = mark(after)
        edges.drop()
        edges = after
        del e, best, hooked, above, doubled
        free_shuffles(spark)
        if now == seen:
            return edges.read().select(F.col("v").alias("node"), F.col("w").alias("component"))
        seen = now

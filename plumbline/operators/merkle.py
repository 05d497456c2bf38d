"""One digest of a set of rows by a Merkle tree: equal sets have equal digests, whatever their order and partitioning.

Leaves are the rows' SHA-256 digests. A node is named by the first hexadecimal digits of the digests below it, and its digest is over
those of its children in order. There are as many levels as the number of rows asks for, so that a node has about
`leaves` leaves, or 16 children, however many rows there are: no set is ever in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(*columns: Column | str) -> Column:
    """Of a row's values as text, with nulls apart from empty ones and each value's length before it."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def depth(rows: int, leaves: int = 64) -> int:
    """Levels below the root so that the lowest nodes have at most about `leaves` leaves each."""
    level = 0
    while rows > leaves * 16**level:
        level += 1
    return level


def _digest_of(children: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(children), "\n"), 256)


def tree(digests: DataFrame, keys: list[str], digest: str, levels: int) -> DataFrame:
    """keys, rows, sha256: the root of each group's tree of that many levels. Equal rows count as often as they are there.

    A lowest node's equal leaves are one entry with their number, so copies don't fill it.
    """
    node = F.substring(F.col(digest), 1, levels) if levels else F.lit("")
    leaves = digests.groupBy(*keys, node.alias("node_"), F.col(digest).alias("leaf_")).agg(F.count(F.lit(1)).alias("n_"))
    entry = F.concat_ws(" ", "leaf_", F.col("n_").cast("string"))
    nodes = leaves.groupBy(*keys, "node_").agg(F.sum("n_").alias("rows"), _digest_of(F.collect_list(entry)).alias("sha256"))
    for level in range(levels - 1, -1, -1):  # sixteen children at most
        up = F.substring("node_", 1, level) if level else F.lit("")
        child = F.concat_ws(" ", "node_", "sha256")
        nodes = nodes.groupBy(*keys, up.alias("up_")).agg(F.sum("rows").alias("rows"), _digest_of(F.collect_list(child)).alias("sha256")).withColumnRenamed("up_", "node_")
    return nodes.select(*keys, "rows", "sha256")


def set_digest(df: DataFrame, keys: list[str], columns: list[str], leaves: int = 64) -> DataFrame:
    """keys, rows, sha256 of each group's rows; the levels follow from the largest group."""
    digests = df.select(*keys, row_digest(*columns).alias("digest_"))
    largest = digests.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return tree(digests, keys, "digest_", depth(largest, leaves))


def largest_node(digests: DataFrame, keys: list[str], digest: str, levels: int) -> int:
    """How many distinct leaves the fullest of the lowest nodes has."""
    node = F.substring(F.col(digest), 1, levels) if levels else F.lit("")
    return digests.groupBy(*keys, node).agg(F.count_distinct(digest).alias("n")).agg(F.max("n")).first()[0]


def dataset_identity(cases: DataFrame, case: str, columns: list[str], cutoff: int) -> DataFrame:
    """One row: cases, sha256 of a dataset under a cutoff; blank and repeated case ids fail the query.

    A case's digest is over its fields and the cutoff, so either's change gives another identity.
    """
    blank = F.coalesce(F.trim(F.col(case).cast("string")), F.lit("")) == ""
    twice = F.count(F.lit(1)).over(Window.partitionBy(F.sha2(F.col(case).cast("string"), 256))) > 1
    sure = F.when(blank | twice, F.raise_error(F.lit("a case id is blank or repeated")).cast("string")).otherwise(row_digest(case, *columns, F.lit(cutoff)))
    digests = cases.select(sure.alias("digest_"))
    return tree(digests, [], "digest_", depth(cases.count())).select(F.col("rows").alias("cases"), "sha256")

"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors, about 8 for each root of their number. A vector is represented
by its `length` nearest pivots in order, and posted in the inverted files of the first `posted` of them. A
query visits the files of its own nearest pivots only. What it finds there is ranked by Spearman's footrule (with l
places and l for the pivots that aren't among them: l(l+1) less twice the sum of l - max(place in query, place
in vector) over the common pivots), and the best part is reranked by exact distance.

Files are dealt into buckets of bounded size; a task has a bucket's files and the queries that visit one
of them. Of equal vectors only as many are posted as a query can want, those with the smallest ids, and
equal query vectors are searched once, so a vector that a third of all rows share is no hot key.

How much must be visited is the data's: where distances hardly differ (vectors spread evenly over a sphere) a tenth of
the files is needed for a recall of 0.9, and the work per query still grows with the table; `reach` says how many.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_POST = "bucket int, vec_id long, near binary, embedding array<double>"


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: none null, zero, or with null or
    non-finite components, and all of the table's commonest length. Of rows that share an id the smallest
    vector counts; a null id doesn't take part."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    v = v.where(~F.exists("embedding", bad)).where(F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    v = v.join(F.broadcast(size), F.size("embedding") == F.col("d"))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots in order; ties to the smaller number."""
    far = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length]


def closeness(near: np.ndarray, mine: np.ndarray, pivots: int, length: int) -> np.ndarray:
    """l(l+1)/2 less half the footrule distance between a query's pivots and each vector's, of which the first l count."""
    place = np.full(pivots, length)
    place[mine[:length]] = np.arange(min(length, len(mine)))
    return np.maximum(length - np.maximum(place[near[:, :length]], np.arange(min(length, near.shape[1]))), 0).sum(axis=1)


def _post(pivots: np.ndarray, length: int, posted: int, visited: int, buckets: int, queries: bool):
    """A row for each bucket that holds one of a vector's files; of a query, one of the files that it visits."""

    def run(batches):
        for batch in batches:
            x, ids = _matrix(batch["embedding"]), batch["vec_id"].to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 1024):
                near = nearest_pivots(x[a : a + 1024], pivots, max(length, visited if queries else posted)).astype(np.int32)
                own = np.sort(near[:, : visited if queries else posted] % buckets, axis=1)
                new = np.ones(own.shape, bool)
                new[:, 1:] = own[:, 1:] != own[:, :-1]
                at, _ = np.nonzero(new)
                rows = [r.tobytes() for r in near]
                yield pa.record_batch(
                    [
                        pa.array(own[new].astype(np.int32)),
                        pa.array(ids[a : a + 1024][at]),
                        pa.array([rows[i] for i in at], pa.binary()),
                        batch["embedding"].slice(a, 1024).take(pa.array(at)),
                    ],
                    names=["bucket", "vec_id", "near", "embedding"],
                )

    return run


def _search(pivots: int, length: int, posted: int, visited: int, buckets: int, k: int, share: float, least: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _OUT.empty_table()
        bucket = vectors["bucket"][0].as_py()
        order = np.argsort(vectors["vec_id"].to_numpy())  # ties to the smaller id
        x, ids = _matrix(vectors["embedding"])[order], vectors["vec_id"].to_numpy()[order]
        near = np.stack([np.frombuffer(b, np.int32) for b in vectors["near"].to_pylist()])[order]
        # the bucket's inverted files
        row, place = np.nonzero(near[:, :posted] % buckets == bucket)
        pivot = near[row, place]
        by_pivot = np.argsort(pivot, kind="stable")
        row, pivot = row[by_pivot], pivot[by_pivot]
        asked, out = queries["vec_id"].to_pylist(), [[], [], []]
        for vector, me, mine in zip(_matrix(queries["embedding"]), asked, queries["near"].to_pylist(), strict=True):
            mine = np.frombuffer(mine, np.int32)
            files = mine[:visited][mine[:visited] % buckets == bucket]
            first, last = np.searchsorted(pivot, files, "left"), np.searchsorted(pivot, files, "right")
            found = np.zeros(len(x), bool)
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                found[row[a:b]] = True
            found = np.flatnonzero(found)
            most = max(least, math.ceil(share * len(found)))
            if len(found) > most:
                close = closeness(near[found], mine, pivots, length)
                found = np.sort(found[np.argsort(-close, kind="stable")[:most]])
            distance = np.sqrt(((x[found] - vector) ** 2).sum(axis=1))
            best = np.argsort(distance, kind="stable")[: k + 1]
            out[0] += [me] * len(best)
            out[1] += ids[found[best]].tolist()
            out[2] += distance[best].tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)

    return run


def nearest(
    embeddings: DataFrame, every: int = 100, k: int = 10, density: float = 8.0, length: int = 64, posted: int = 4, reach: float = 0.1, visited: int = 256, share: float = 0.3, least: int = 320, block: int = 32_768
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Nearness: Euclidean distance in double precision, ties to the smaller vec_id; a row isn't its own
    neighbour. Rows that valid_vectors leaves out take no part. At most k rows a query, all there are if
    fewer; an empty table gives none. density: pivots for each root of the number of vectors, 65,536 at most.
    reach and visited: the share of all files that a query visits, and how many at least. share and least: how
    many of a bucket's candidates are reranked. block: postings in a bucket. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    v = Written(valid_vectors(embeddings), "vectors").read()
    free_shuffles(spark)
    total = v.count()
    count = min(65_536, max(64, int(density * math.sqrt(total))))
    sample = v.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").select("embedding").limit(count).collect()
    pivots = np.unique(np.array([r[0] for r in sample], np.float64).reshape(len(sample), len(sample[0][0]) if sample else 0), axis=0)
    length, posted = max(1, min(length, (len(pivots) + 1) // 2)), min(posted, max(1, len(pivots)))
    visited = min(len(pivots), max(visited, math.ceil(reach * len(pivots))))
    buckets = max(8, math.ceil(total * posted / block))
    # of equal vectors the k + 1 smallest ids can be wanted: k, and the query's own
    copies = v.withColumn("copy", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("copy") <= k + 1).select("vec_id", "embedding")
    queries = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = Written(queries.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding"), "asked").read()
    posts = bounded(copies).mapInArrow(_post(pivots, length, posted, visited, buckets, False), _POST)
    visits = bounded(asked).mapInArrow(_post(pivots, length, posted, visited, buckets, True), _POST)
    search = _search(len(pivots), length, posted, visited, buckets, k, share, least)
    found = posts.groupBy("bucket").cogroup(visits.groupBy("bucket")).applyInArrow(search, "query_id long, vec_id long, score double").distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = Written(found.withColumn("place", best).where(F.col("place") <= k + 1), "found").read()
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))  # k + 1 at most
    own = queries.join(asked.select(F.col("vec_id").alias("query_id"), "embedding"), "embedding").select("query_id", F.col("vec_id").alias("me"))
    free_shuffles(spark)
    rows = own.join(lists, "query_id").select("me", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("me")), 1, k)).alias("pos", "b"))
    return rows.select(F.col("me").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))

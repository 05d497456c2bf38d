"""Reuse of vectors by content: a table of vectors whose key is the model's identity and the exact token rows.

What was encoded before is found by its key and never encoded again; a changed model, revision or token is another key. New vectors
become part of the table only when all of them are valid, by one rename of a whole folder: a failed encoding leaves the
table as it was, so it can't poison later calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, vector array<double>"


class EncodingError(ValueError):
    """Vectors that can't be kept; the message has counts, not values."""


def token_key(model: dict[str, str], tokens: Column) -> Column:
    """SHA-256 of the model's fields, by name, and the token ids; null where there are no tokens, or a null or negative one."""
    named = "".join(f"{len(k)}:{k}={len(v)}:{v};" for k, v in sorted(model.items()))
    valid = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isNotNull() & (t >= 0))
    return F.when(valid, F.sha2(F.concat(F.lit(named), F.array_join(tokens, ",")), 256))


def keyed(asked: DataFrame, model: dict[str, str], tokens: str) -> DataFrame:
    return asked.withColumn("key", token_key(model, F.col(tokens)))


def reuse_plan(store: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: asked, invalid (rows without a key), distinct, hits, misses (keys); asked: keyed rows."""
    keys = asked.where("key is not null").select("key").distinct().join(store.select("key", F.lit(True).alias("known_")), "key", "left")
    found = keys.agg(F.count(F.lit(1)).alias("distinct"), F.count("known_").alias("hits"), F.count_if(F.col("known_").isNull()).alias("misses"))
    rows = asked.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("key").isNull()).alias("invalid"))
    return rows.crossJoin(F.broadcast(found)).select("asked", "invalid", "distinct", "hits", "misses")


class VectorStore:
    """Vectors of one length below a folder that all executors share: one folder below it for each commit."""

    def __init__(self, spark: SparkSession, path: str, length: int):
        self.spark, self.path, self.length = spark, path.rstrip("/"), length

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def read(self) -> DataFrame:
        files, place = self._files(f"{self.path}/commits")
        if not files.exists(place):
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        return found.groupBy("key").agg(F.first("vector").alias("vector"))  # two callers may have filled one key

    def fill(self, asked: DataFrame, tokens: str, encoder: Callable[[Column], Column]) -> int:
        """Encodes what the table lacks, each token row once, and commits it if every vector is finite and of the right length. How many are new."""
        lacking = asked.where("key is not null").join(self.read().select("key"), "key", "left_anti").groupBy("key").agg(F.first(tokens).alias(tokens))
        made = lacking.select("key", encoder(F.col(tokens)).cast("array<double>").alias("vector"))
        name = uuid.uuid4().hex
        made.write.option("compression", "zstd").parquet(f"{self.path}/staged/{name}")
        staged = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/staged/{name}")
        whole = F.coalesce((F.size("vector") == self.length) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        new, good = staged.agg(F.count(F.lit(1)), F.count_if(whole)).first()
        files, place = self._files(f"{self.path}/staged/{name}")
        if good < new:
            files.delete(place, True)
            raise EncodingError(f"{new - good} of {new} vectors aren't finite and of length {self.length}; nothing is kept")
        target = self._files(f"{self.path}/commits/{name}")[1]
        files.mkdirs(target.getParent())
        if not files.rename(place, target):
            raise EncodingError("the new vectors couldn't be put in place")
        return new

    def look_up(self, asked: DataFrame) -> DataFrame:
        """The keyed rows with `vector`; null for rows that are invalid or not encoded yet."""
        return asked.join(self.read(), "key", "left")

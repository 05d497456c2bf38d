"""Exact dedup by a minimal perfect hash over historical digests.

The history is a set of documents seen before; a batch of new ones is held against it. Distinct digests
go to buckets of their range. A bucket builds a minimal perfect hash over its historical digests: level
by level, keys that are alone on a bit of the level's bit vector are settled there, the others go on to
the next level, and a settled key's slot is the number of bits set before its own. A slot holds the full
digest and the winner's locator, so a lookup is right only if all 32 bytes agree. New digests that are no
members form groups of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, free_shuffles, fresh

_RUN = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 of the text with each [\\x20\\x09-\\x0D]+ as one space; null counts as empty.

    Texts that aren't valid UTF-8 are taken byte by byte, so that none of their bytes is replaced.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    latin = F.decode(text.cast("binary"), "ISO-8859-1")
    by_byte = F.sha2(F.encode(F.regexp_replace(latin, _RUN, " "), "ISO-8859-1"), 256)
    return F.unhex(F.when(F.is_valid_utf8(text), F.sha2(F.regexp_replace(text, _RUN, " "), 256)).otherwise(by_byte))


class PerfectHash:
    """Minimal and perfect over distinct 32-byte keys (an n x 32 array of bytes)."""

    GAMMA = 1.5

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        left = keys
        while len(left):
            m = max(64, int(len(left) * self.GAMMA))
            at = self._place(left, len(self.levels), m)
            bits = np.bincount(at, minlength=m) == 1
            before = np.cumsum(bits) - bits + self.size
            self.levels.append((bits, before))
            self.size += int(bits.sum())
            left = left[~bits[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        a, b, c = (keys[:, i : i + 8].copy().view(np.uint64).ravel() for i in (8, 16, 24))
        x = a + b * np.uint64(2 * level + 1) + c * np.uint64(level * level)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; members have their own, others any or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self._place(keys[todo], level, len(bits))
            out[todo[bits[at]]] = before[at[bits[at]]]
            todo = todo[~bits[at]]
        return out


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


_FOUND = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _look_up(history: pa.Table, fresh: pa.Table) -> pa.Table:
    old, new = _bytes(history["digest"]), _bytes(fresh["digest"])
    index = PerfectHash(old)
    slot = index.slots(old)
    digests, winner, size = np.empty_like(old), np.empty(len(old), np.int64), np.empty(len(old), np.int64)
    digests[slot] = old
    has_winner = np.empty(len(old), bool)
    has_winner[slot] = history["keep_id"].is_valid().to_numpy()
    winner[slot] = history["keep_id"].fill_null(0).to_numpy()
    size[slot] = history["group_size"].to_numpy()
    at = index.slots(new)
    member = at >= 0
    member[member] = (digests[at[member]] == new[member]).all(axis=1)
    at = at[member]
    new_id, new_has, new_size = fresh["keep_id"].fill_null(0).to_numpy(), fresh["keep_id"].is_valid().to_numpy(), fresh["group_size"].to_numpy()
    # members: the winner is the smaller of both locators; the others stay in their own group
    big = np.iinfo(np.int64).max
    both = np.minimum(np.where(has_winner[at], winner[at], big), np.where(new_has[member], new_id[member], big))
    winner[at], has_winner[at] = both, has_winner[at] | new_has[member]
    size[at] += new_size[member]
    keys = [*map(bytes, digests), *map(bytes, new[~member])]
    ids = np.concatenate([winner, new_id[~member]])
    has = np.concatenate([has_winner, new_has[~member]])
    return pa.table([pa.array(keys, pa.binary()), pa.array(ids, pa.int64(), mask=~has), pa.array(np.concatenate([size, new_size[~member]]))], schema=_FOUND)


def hold_against_history(history: DataFrame, fresh: DataFrame, bucket_keys: int = 200_000) -> DataFrame:
    """digest, keep_id, group_size over both; history and fresh: doc_id, digest."""
    old, new = (d.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")) for d in (history, fresh))
    n = max(1, math.ceil((history.count() + fresh.count()) / bucket_keys), int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    old, new = (d.withColumn("bucket", bucket) for d in (old, new))
    return old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_look_up, "digest binary, keep_id long, group_size long")


def exact_dedup(documents: DataFrame, history_share: float = 0.5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document, dropped ones too.

    Texts are equal when identical after each [\\x20\\x09-\\x0D]+ became one space; null is empty. The row
    with the smallest doc_id stays. The history is the rows up to about that share of the ids. Rows
    that share the smallest doc_id all stay, as it can't tell them apart. A row with a null doc_id stays
    only if its group has no other id, and keep_id is null then. Other columns are ignored; an empty table gives none.
    Only digests of texts are kept, so their length doesn't matter (one value, so under 2 GB).
    """
    spark = documents.sparkSession
    digests = Written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    split = digests.read().agg(F.percentile_approx("doc_id", history_share, 1000)).first()[0]
    past = F.coalesce(F.col("doc_id") <= F.lit(split).cast("long"), F.lit(False))
    found = hold_against_history(digests.read().where(past), digests.read().where(~past))
    free_shuffles(spark)
    out = digests.read().join(found, "digest")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(documents: DataFrame, history_share: float = 0.5) -> DataFrame:
    """The documents' rows without repeats: one row of each group of equal texts.

    Rows are told apart by doc_id and digest, so an id that two texts share loses only the text that goes.
    Of equal rows of one id, a null id too, one stays: any, as only other columns can differ.
    """
    key, own, there = fresh(documents, "key_"), fresh(documents, "digest_"), fresh(documents, "there_")
    decided = Written(exact_dedup(documents, history_share).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "kept").read()

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(there)).hint("shuffle_hash")  # texts stream by, unsorted

    texts = documents.withColumn(own, digest(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(there))
    once = texts.join(named(decided.where("not kept or n > 1")), same, "left_anti").drop(own)
    repeated = decided.where("kept and n > 1")
    if repeated.isEmpty():
        return once
    some = texts.join(named(repeated), same, "left_semi").withColumn(key, F.col("doc_id").cast("long"))
    return once.unionByName(some.dropDuplicates([key, own]).drop(key, own))

"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text: its words (runs of letters and digits, and runs of marks), pairs and triples of
neighbouring words, hashed into one table; a feature's value is
the root of its count, and a text's vector has length one. A score is the logistic function of the
sparse dot product with the weights.

Training takes a bounded sample of the labelled rows (`max_train`, those with the smallest hash of the
doc_id) in one task, since each update needs the one before; scoring takes all rows. The weights are a
fixed table of 2**bits floats, and so may be broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded, fresh
from .hashing import Rolling, join_bytes, mix

_WORDS = Rolling(21)

#: What a byte is: white space, part of a word (letters, digits, all beyond ASCII), or a mark.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    n_grams: int = 3
    max_train: int = 16_384
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.001


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4, is 2: never trained on."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and of runs of marks, as tokens of their own, and each one's text number."""
    kind, bounds = _KIND[buf], np.cumsum(lengths)
    cut = np.zeros(len(buf) + 1, bool)
    cut[0], cut[bounds] = True, True
    cut[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(cut)
    inside = kind[at[:-1]] > 0
    start = at[:-1][inside]
    return start, at[1:][inside], np.searchsorted(bounds, start, side="right")


def features(texts: list[bytes], bits: int, n_grams: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and value, in order of text and feature; every text has the feature 0 (the bias)."""
    buf, lengths = join_bytes(texts)
    start, end, doc = words(buf, lengths)
    gram = _WORDS.spans(_WORDS.prefix(_WORDS.codes[buf]), start, end)
    word, keys, n, size = gram, [], len(texts), np.uint64((1 << bits) - 1)
    for k in range(n_grams):
        inside = doc[: len(gram)] == doc[k:]
        keys.append((doc[: len(gram)][inside].astype(np.uint64) << np.uint64(bits)) | (mix(gram[inside] + np.uint64(k)) % size + np.uint64(1)))
        gram = mix(gram[:-1] * np.uint64(3) + word[k + 1 :])
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(new, append=len(key))
    key = key[new]
    at, feature, value = (key >> np.uint64(bits)).astype(np.int64), (key & size).astype(np.int32), np.sqrt(count)
    norm = np.sqrt(np.bincount(at, weights=value * value, minlength=n))
    value = value / norm[at]
    order = np.argsort(np.concatenate([np.arange(n), at]), kind="stable")
    at, feature, value = np.concatenate([np.arange(n), at]), np.concatenate([np.zeros(n, np.int32), feature]), np.concatenate([np.ones(n), value])
    return at[order], feature[order], value[order].astype(np.float32)


def _tight(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _loose(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), kind)


def slices(texts: list[bytes], most: int = 1 << 19) -> Iterator[slice]:
    """Neighbouring texts of together about `most` bytes."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class FollowTheLeader:
    """FTRL-proximal for logistic loss, with a learning rate for each coordinate."""

    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, s = self.z[at], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(value @ w, -35, 35)))
        g = (p - label) * value
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = after


def _features(s: Settings):
    def run(batches):
        for batch in batches:
            texts, rows = [x or b"" for x in batch["text"].to_pylist()], []
            for part in slices(texts):
                at, feature, value = features(texts[part], s.bits, s.n_grams)
                cut = np.searchsorted(at, np.arange(part.stop - part.start + 1))
                # in order, so that their steps and most values compress to little
                rows += [(_tight(np.diff(feature[a:b], prepend=np.int32(0))), _tight(value[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch(
                [batch["place"], batch["label"], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["place", "label", "feature", "value"],
            )

    return run


def _train(s: Settings):
    """One pass over rows that hold every epoch in turn; nothing but the table of weights is kept."""

    def run(batches):
        leader = FollowTheLeader(s)
        for batch in batches:
            for x in batch.to_pylist():
                leader.learn(np.cumsum(_loose(x["feature"], np.int32)), _loose(x["value"], np.float32).astype(np.float64), x["label"])
        yield pa.record_batch([pa.array([leader.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    return run


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights learnt from labels.quality of rows that aren't held out; all zero without such rows.

    Documents whose labels contradict each other, and null labels and ids, teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    place = F.xxhash64(F.lit(1), "doc_id")
    known = known.where("doc_id is not null and label = most").select("doc_id", "label", place.alias("place"))
    sample = known.orderBy("place", "doc_id").limit(settings.max_train)  # bounded, so it may be broadcast
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # rows that share an id teach by one of their texts, so that rows are bounded too
    docs = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "place", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    rows = bounded(docs.select("place", "label", "text")).mapInArrow(_features(settings), "place long, label int, feature binary, value binary")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(settings.epochs))))
    row = bounded(rows.repartition(1).sortWithinPartitions("epoch", "place", "feature")).mapInArrow(_train(settings), "weights binary").collect()
    return np.frombuffer(row[0]["weights"], np.float32) if row else np.zeros(1 << settings.bits, np.float32)


def score(documents: DataFrame, weights: np.ndarray, settings: Settings = Settings(), name: str = "score") -> DataFrame:
    """The documents' columns and, in a new last column, each text's score."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    place = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            texts, out = [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()], [np.zeros(0)]
            for part in slices(texts):
                at, feature, value = features(texts[part], settings.bits, settings.n_grams)
                dot = np.bincount(at, weights=sent.value[feature].astype(np.float64) * value, minlength=part.stop - part.start)
                out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, name])

    return bounded(documents).mapInArrow(run, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def classify_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts get the bias alone. A null doc_id isn't held out. Labels, languages, sources and
    ids are no inputs of a score. Other columns are ignored; an empty table gives none. Repeated rows have equal scores, and a score equal to
    the threshold is accepted. Texts are scored whole, however long (one value, so under 2 GB).
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, train(documents, labels, settings), settings)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents that the classifier accepts."""
    name = fresh(documents, "score_")
    return score(documents, train(documents, labels, settings), settings, name).where(F.col(name) >= threshold).drop(name)


def crc_held_out(doc_id: int) -> bool:
    """The same rule in Python."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2

"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code over the fingerprint's bits: a direct sum of perfect cyclic
codes on separate blocks of bits (two binary Golay codes of length 23 and radius 3, and a Hamming code of
length 15 and radius 1): 2^35 anchors, so that few fingerprints share one at any size of the table. Each block lies within its radius r of
exactly one code word, so each fingerprint has one home anchor. If x and y differ in at most t bits, t_i
of them in block i, then y lies within r_i + t_i of x's home word in each block. So every distinct
fingerprint goes to its home, and to all anchors within the radius plus the threshold; those that meet
at an anchor are compared, all 64 bits. Every pair within the threshold meets at the home of either.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles
from .components import connected_components
from .near_copies import keep_dissimilar

#: Length, generator polynomial and radius of the perfect cyclic codes.
GOLAY, HAMMING = (23, 0b110001110101, 3), (15, 0b10011, 1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; bit b is set if over half the shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()  # of bytes: A-Z only, and at [\\x20\\x09-\\x0D]
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words)))
        digest = xxhash.xxh64_intdigest
        # word i starts after i spaces and all words before it
        hashes = [digest(joined[a + i : b + i + shingle - 1], 42) for i, (a, b) in enumerate(zip([0, *ends], ends[shingle - 1 :], strict=False))]
    h = np.array(hashes, np.uint64)
    set_ = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x or b"", shingle) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch["doc_id"], pa.array(prints)], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return bounded(docs).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


@dataclass(frozen=True)
class Block:
    """patterns[e][first[e][s]:][:count[e][s]]: differences to code words, for syndrome s, of up to radius + e bits."""

    shift: int
    length: int
    tables: tuple
    patterns: tuple
    first: tuple
    count: tuple

    def syndromes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = (x >> np.uint64(self.shift)) & np.uint64((1 << self.length) - 1)
        out = np.zeros(len(x), np.int64)
        for k, t in enumerate(self.tables):
            out ^= t[((word >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
        return word, out


@cache
def blocks(codes: tuple, threshold: int) -> tuple[Block, ...]:
    out, shift = [], 0
    for length, generator, radius in codes:
        degree = generator.bit_length() - 1
        single = np.empty(length, np.int64)
        for i in range(length):
            r = 1 << i
            while r.bit_length() > degree:
                r ^= generator << (r.bit_length() - 1 - degree)
            single[i] = r
        tables = []
        for k in range(0, length, 8):
            t = np.zeros(256, np.int64)
            for b in range(min(8, length - k)):
                t[(np.arange(256) >> b & 1) == 1] ^= single[k + b]
            tables.append(t)
        patterns, first, count = [], [], []
        for e in range(threshold + 1):
            weights = range(radius + 1) if e == 0 else [radius + e]
            rows = [c for w in weights for c in itertools.combinations(range(length), w)]
            pattern = np.array([sum(1 << i for i in c) for c in rows], np.uint64)
            syndrome = np.array([np.bitwise_xor.reduce(single[list(c)]) if c else 0 for c in rows], np.int64)
            order = np.argsort(syndrome, kind="stable")
            n = np.bincount(syndrome, minlength=1 << degree)
            patterns.append(pattern[order])
            first.append(np.cumsum(n) - n)
            count.append(n)
        out.append(Block(shift, length, tuple(tables), tuple(patterns), tuple(first), tuple(count)))
        shift += length
    return tuple(out)


def anchors(x: np.ndarray, codes: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each fingerprint's anchors within radius and threshold: the fingerprint's place, the anchor, whether it's its home."""
    at, anchor, home = [], [], []
    parts = blocks(codes, threshold)
    known = [b.syndromes(x) for b in parts]
    for over in itertools.product(range(threshold + 1), repeat=len(parts)):
        if sum(over) > threshold:
            continue
        place, value = np.arange(len(x)), np.zeros(len(x), np.uint64)
        for b, e, (word, syndrome) in zip(parts, over, known, strict=True):
            n = b.count[e][syndrome[place]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, value = np.repeat(place, n), np.repeat(value, n)
            pattern = b.patterns[e][b.first[e][syndrome[place]] + inner]
            value = value | ((word[place] ^ pattern) << np.uint64(b.shift))
        at.append(place)
        anchor.append(value)
        home.append(np.full(len(place), sum(over) == 0))
    return tuple(np.concatenate(c) for c in (at, anchor, home))


def _replicate(codes: tuple, threshold: int, only_home: bool):
    def run(batches):
        for batch in batches:
            x, node = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64), batch["node"].to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 4096):
                at, anchor, home = anchors(x[a : a + 4096], codes, 0 if only_home else threshold)
                yield pa.record_batch([anchor.view(np.int64), x[a : a + 4096][at].view(np.int64), node[a : a + 4096][at]], names=["anchor", "fp", "node"])

    return run


def simhash_links(nodes: DataFrame, threshold: int, codes: tuple) -> DataFrame:
    """nodes: fp (distinct), node. Returns v, w: nodes within the threshold."""
    probes = nodes.mapInArrow(_replicate(codes, threshold, False), "anchor long, fp long, node long")
    homes = nodes.mapInArrow(_replicate(codes, threshold, True), "anchor long, fp long, node long")
    homes = homes.select("anchor", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= threshold
    return probes.join(homes, "anchor").where(near & (F.col("fp") != F.col("fp2"))).select(F.greatest("node", "node2").alias("v"), F.least("node", "node2").alias("w"))


def simhash_dedup(documents: DataFrame, shingle: int = 3, threshold: int = 2, codes: tuple = (GOLAY, GOLAY, HAMMING)) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    Documents whose fingerprints differ in at most `threshold` bits are linked; component_id is the
    smallest doc_id that links reach. Null and empty texts have fingerprint zero and are linked like any
    other. A row with a null doc_id is no one's component_id; it gets that of the others it reaches, null
    if there are none. Repeated rows give repeated rows. Other columns are ignored; an empty table gives none. Any codes give the same links.
    Very long texts are hashed whole, with 8 bytes a shingle in a task; a text is one value, so under 2 GB.
    """
    spark = documents.sparkSession
    prints = Written(fingerprints(documents, shingle), "fingerprints")
    nodes = Written(prints.read().where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    free_shuffles(spark)
    found = connected_components(simhash_links(nodes.read(), threshold, codes))
    by_print = nodes.read().join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.read().join(by_print, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(documents: DataFrame, shingle: int, threshold: int, codes: tuple = (GOLAY, GOLAY, HAMMING)) -> DataFrame:
    """a < b: doc_ids whose links join all documents whose fingerprints are within the threshold."""
    prints = Written(fingerprints(documents, shingle).where("doc_id is not null"), "fingerprints").read()
    nodes = Written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes").read()
    same = prints.join(nodes, "fp").where("doc_id > node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return same.unionAll(simhash_links(nodes, threshold, codes).select(F.col("w").alias("a"), F.col("v").alias("b"))).distinct()


def keep_representatives(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """The documents' rows without near copies: one document of each group, that with the smallest doc_id, stays.

    Documents are linked if the Jaccard similarity of their word shingles says so. Fingerprints within the
    threshold propose pairs, and near_copies.py proposes those that lie further apart. Rows with a null doc_id
    stay, as a decision can't name them; rows that share a staying id all stay.
    """
    return keep_dissimilar(documents, shingle, similarity, near_pairs(documents, shingle, threshold))

"""Near copies by word shingles: candidates by SimHash anchors and MinHash bands, decided by the exact Jaccard similarity.

SimHash distances of texts at similarity 0.8 reach 11 of 64 bits and more, and the anchors of `simhash.py`
can't cover so wide a radius. 64 bands of 8 minima miss a pair at 0.8 with probability
(1 - 0.8^8)^64, under 1e-5, and a closer one with less. A proposed pair counts only if its shingle sets say so.

Candidates of one band's bucket are held against the bucket's smallest document first. Members that are still
in different components are then compared with each other by their minima, a block of members against a block in
a task, and only pairs whose minima agree to at least five standard errors below the similarity go on to their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles, fresh
from .components import connected_components
from .hashing import Rolling, join_bytes, mix, word_spans

BANDS, ROWS = 64, 8
_BYTES, _WORDS = Rolling(51), Rolling(52)
_RNG = np.random.default_rng(33)
_XORS, _FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64), _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, text by text, and how many each text has: at least one.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z as a-z. A text of fewer words than a shingle is one shingle.
    """
    buf, lengths = join_bytes([t.lower() for t in texts])
    starts, ends, at = word_spans(buf, lengths)
    n = np.bincount(at, minlength=len(texts))
    words = _BYTES.spans(_BYTES.prefix(_BYTES.codes[buf]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    windows = _WORDS.windows(words, size)
    inside = at[: len(windows)] == at[size - 1 :][: len(windows)]
    short = np.flatnonzero(n < size)
    first = np.cumsum(n) - n
    whole = _WORDS.spans(_WORDS.prefix(words), first[short], (first + n)[short])
    owner, value = np.concatenate([at[: len(windows)][inside], short]), np.concatenate([windows[inside], whole])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def sketches(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set: BANDS keys, and a byte of each of its minima."""
    first = np.cumsum(count) - count
    out, minima = np.empty((len(count), BANDS), np.uint64), np.empty((len(count), BANDS * ROWS), np.uint8)
    for band in range(BANDS):
        key = np.full(len(count), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((value ^ _XORS[k]) * _FACTORS[k], first)
            key = mix(key * _FACTORS[0] + least)
            minima[:, k] = mix(least) & np.uint64(255)
        out[:, band] = key
    return out, minima


def _slices(texts: list, most: int = 1 << 20):
    """Stretches of texts of about so many bytes."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_SKETCH = "doc_id long, n long, keys array<long>, minima binary"


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch["doc_id"], [t or b"" for t in batch["text"].to_pylist()]
            for a, b in _slices(texts):
                value, count = shingle_sets(texts[a:b], size)
                keys, minima = sketches(value, count)
                cut = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32))
                yield pa.record_batch(
                    [ids.slice(a, b - a), pa.array(count), pa.ListArray.from_arrays(cut, pa.array(keys.ravel().view(np.int64))), pa.array([m.tobytes() for m in minima], pa.binary())],
                    names=["doc_id", "n", "keys", "minima"],
                )

    return run


def least_agreement(similarity: float) -> float:
    """Five standard errors of the estimate below the similarity."""
    return similarity - 5 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _agreeing(similarity: float, step: int = 64):
    """Pairs of a block's members and another's, of different components, whose minima agree; in the first band that they share only."""
    least = least_agreement(similarity)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        ids, parts, n, side = (t[c].to_numpy() for c in ("doc_id", "part", "n", "side"))
        minima = np.frombuffer(b"".join(t["minima"].to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.array(t["keys"].to_pylist(), np.int64).reshape(len(ids), -1)
        band, one_block, out = int(t["band"][0].as_py()), t["x"][0].as_py() == t["y"][0].as_py(), []
        left, right = np.flatnonzero(side == 0), np.arange(len(ids)) if one_block else np.flatnonzero(side == 1)
        for a in range(0, len(left), step):
            rows = left[a : a + step]
            small, big = np.minimum.outer(n[rows], n[right]), np.maximum.outer(n[rows], n[right])
            i, j = np.nonzero((parts[rows][:, None] != parts[right]) & (small >= similarity * big))
            i, j = rows[i], right[j]
            if one_block:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 14):
                x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                ok = (minima[x] == minima[y]).mean(axis=1) >= least
                x, y = x[ok], y[ok]
                x, y = (z[~(keys[x, :band] == keys[y, :band]).any(axis=1)] for z in (x, y))
                out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        return pa.table([pa.array(a), pa.array(b)], schema=_PAIR)

    return run


def shingles(text: bytes, size: int) -> set[bytes]:
    """The shingles themselves, so that equal hashes of different words can't make a link."""
    words = text.lower().split()  # of bytes: A-Z only, and at [\\x20\\x09-\\x0D]
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or {b" ".join(words)}


def _similar(size: int, similarity: float):
    def run(batches):
        for batch in batches:
            sets: dict[bytes, set[bytes]] = {}

            def of(t: bytes | None, sets=sets) -> set[bytes]:
                t = t or b""
                if t not in sets:
                    if len(sets) >= 64:
                        sets.clear()
                    sets[t] = shingles(t, size)
                return sets[t]

            keep = []
            for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                x, y = of(x), of(y)
                both = len(x & y)
                keep.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.record_batch([batch["b"], batch["a"]], names=["v", "w"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """v, w: those of the pairs a < b whose texts are similar."""
    pairs = pairs.hint("shuffle_hash")  # texts stream by, unsorted
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(pairs, "a")
    two = one.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return bounded(two.select("a", "b", "text_a", "text_b")).mapInArrow(_similar(size, similarity), "v long, w long")


def near_links(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, proposed: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """v > w: doc_ids whose links join all documents that are similar, directly or through others.

    proposed: further pairs a < b to look at first. Null and empty texts have one empty shingle. Rows with a null id have no links.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = Written(bounded(docs).mapInArrow(_sketch(shingle), _SKETCH), "sketches").read()
    bands = sketch.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.max("doc_id").alias("top"), F.count("*").alias("size")).where("c.doc_id < top")
    shared = shared.select("band", "key", "size", F.col("c.doc_id").alias("center"), F.col("c.n").alias("center_n"))
    members = Written(bands.join(shared, ["band", "key"]), "members").read()
    close = lambda m, n: F.least(m, n) / F.greatest(m, n) >= similarity  # noqa: E731  no sets of other sizes are similar
    stars = members.where((F.col("doc_id") > F.col("center")) & close("n", "center_n")).select(F.col("center").alias("a"), F.col("doc_id").alias("b"))
    stars = Written((stars if proposed is None else stars.unionAll(proposed.select("a", "b"))).distinct(), "pairs")
    first = Written(_verified(stars.read(), docs, shingle, similarity), "links")
    free_shuffles(spark)
    part = members.join(connected_components(first.read()), F.col("doc_id") == F.col("node"), "left").select("band", "key", "size", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    part = Written(part, "members").read()
    open_ = part.groupBy("band", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("band", "key")
    # a bucket is as many blocks as it needs; a member goes to each pair of blocks that its own is in
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = part.join(open_, ["band", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id", "band"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", "doc_id", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    beside = dealt.join(sketch.select("doc_id", "n", "keys", "minima"), "doc_id")
    others = bounded(beside).groupBy("band", "key", "x", "y").applyInArrow(_agreeing(similarity), "a long, b long").distinct()
    others = Written(others.join(stars.read(), ["a", "b"], "left_anti"), "pairs")
    rest = Written(_verified(others.read(), docs, shingle, similarity), "links")
    free_shuffles(spark)
    return first.read().unionAll(rest.read())


def keep_dissimilar(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, proposed: DataFrame | None = None) -> DataFrame:
    """The documents' rows without near copies: of documents linked by similarity that with the smallest doc_id.

    Rows with a null doc_id stay, as a decision can't name them.
    """
    name = fresh(documents, "gone_")
    gone = connected_components(near_links(documents, shingle, similarity, proposed)).select(F.col("node").alias(name)).distinct().hint("shuffle_hash")  # texts stream by, unsorted
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")

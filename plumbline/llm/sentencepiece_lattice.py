"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has its bytes as nodes and the vocabulary's pieces as edges; an edge's weight is the
piece's probability to the power theta. The public vocabulary is of the BPE kind: it holds merge ranks,
not probabilities, and a piece of rank r is given a probability in proportion to 1 / (r + 1). Forward
filtering sums the weights of all paths to a node; backward sampling goes from the end and draws each
edge in proportion to what it adds to its node. So each segmentation comes with exactly its share.
The draws are a hash of seed, row key, unit and step: the same on any partitioning, and on every retry.

Pieces have no space after another character, so the lattice falls apart before each run of spaces into
units, and units are sampled one by one without changing any share. Equal units of a slice of texts
share one forward pass. All is vectorised over a slice's units, one step of the lattice at a time.

Text is taken as it is: no normalisation, no added space. A space is written as the piece character
U+2581; characters without a piece, U+2581 itself among them, and bytes that aren't UTF-8 are spelt in
byte pieces. Hashes find pieces and group equal units; bytes decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .hashing import Rolling, join_bytes, mix
from .quality import slices
from .suffix_order import eight_bytes, same_bytes, same_words

#: The public vocabulary's place; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"

_HASH = Rolling(31)


@dataclass
class Vocabulary:
    """Pieces as bytes (b"" if they're no text), log-weights, and the byte pieces' ids."""

    pieces: list[bytes]
    weight: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self):
        self.size = np.array([len(p) for p in self.pieces])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.words = eight_bytes(self.bytes)
        text = np.ones(len(self.pieces), bool)
        text[self.byte_ids] = False
        self.tables, prefixes = {}, {}
        for i in np.flatnonzero(text & (self.size > 0)):
            p = self.pieces[i]
            self.tables.setdefault(len(p), []).append((p, i))
            for n in range(1, len(p)):
                prefixes.setdefault(n, set()).add(p[:n])
        self.tables = {n: Strings([p for p, _ in rows], [i for _, i in rows]) for n, rows in self.tables.items()}
        self.prefixes = {n: Strings(list(s), [0] * len(s)) for n, s in prefixes.items()}


class Strings:
    """Hashes of strings of one length in order, entered by their first 16 bits."""

    def __init__(self, strings: list[bytes], ids: list[int]):
        buf, n = join_bytes(strings)
        end = np.cumsum(n)
        h = _HASH.spans(_HASH.prefix(_HASH.codes[buf]), end - n, end)
        order = np.argsort(h)
        self.hash = np.append(h[order], np.uint64(0))
        self.ids = np.array(ids, np.int32)[order]
        slots = (self.hash[:-1] >> np.uint64(48)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(65536)).astype(np.int32)
        self.most = int(np.bincount(slots).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are known, and their strings' ids."""
        begin = self.first[(h >> np.uint64(48)).astype(np.int64)]
        at, found = [], []
        for k in range(self.most):
            entry = np.minimum(begin + k, len(self.ids))
            hit = np.flatnonzero(self.hash[entry] == h)
            at.append(hit)
            found.append(entry[hit])
        at, found = np.concatenate(at), np.concatenate(found)
        real = found < len(self.ids)
        return at[real], self.ids[found[real]]


def load_vocabulary(model: str = MODEL, theta: float = 1.0) -> Vocabulary:
    """Read on the driver; the table has a fixed size and is sent to the executors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces, weight, byte_ids = [], np.zeros(n), np.full(256, -1)
    for i in range(n):
        name, score = sp.id_to_piece(i), sp.get_score(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
            weight[i] = -theta * np.log(n + 1)
        elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            if SPACE in name.lstrip(SPACE):
                raise ValueError(f"piece {i} has a space after another character: units can't be sampled apart")
            pieces.append(name.replace(SPACE, " ").encode())
            weight[i] = -theta * np.log(1 - score)
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces, so that encoding can't be lossless")
    return Vocabulary(pieces, weight, byte_ids)


def _units(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and their text: a new one at each text's start and before each run of spaces."""
    bounds = np.cumsum(lengths)
    new = np.zeros(len(buf) + 1, bool)
    new[bounds - lengths] = True
    space = buf == 0x20
    new[1:-1] |= space[1:] & ~space[:-1]
    new[-1] = False
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(buf)), np.searchsorted(bounds, start, side="right")


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct unit, and each unit's number. A hash groups them, their bytes decide."""
    codes = _HASH.spans(_HASH.prefix(_HASH.codes[buf]), start, end)
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    if not (((end - start)[first][number] == end - start) & same_bytes(buf, start[first][number], start, np.minimum(end - start, (end - start)[first][number]))).all():
        seen: dict[bytes, int] = {}
        first, number = [], np.empty(len(start), np.int64)
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            if (k := seen.setdefault(buf[a:b].tobytes(), len(first))) == len(first):
                first.append(i)
            number[i] = k
        first = np.array(first)
    return first, number


class Lattice:
    """Of distinct units, with one node before and after each byte: edges by end node, and each edge's cumulative share."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        base = np.cumsum(size + 1) - (size + 1)
        take = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = buf[take]
        unit = np.repeat(np.arange(len(size)), size)
        stop = np.cumsum(size)[unit]  # of the unit, in own
        node = np.arange(len(own)) + unit  # before each byte
        prefix = _HASH.prefix(_HASH.codes[own])
        alive, begin, after, piece = np.arange(len(own)), [], [], []
        single = np.zeros(len(own), bool)  # has a piece for its one character
        words = eight_bytes(own)
        lead = (own & 0xC0) != 0x80
        chars = np.where(own < 0x80, 1, np.where(own < 0xE0, 2, np.where(own < 0xF0, 3, 4)))
        alive = alive[lead]
        n = 0
        while len(alive):
            n += 1
            alive = alive[alive + n <= stop[alive]]
            h = _HASH.spans(prefix, alive, alive + n)
            if n in v.tables:
                at, ids = v.tables[n].find(h)
                at = alive[at]
                same = same_words(words, at, v.words, v.start[ids], np.full(len(at), n))
                at, ids = at[same], ids[same]
                begin.append(at)
                after.append(np.full(len(at), n))
                piece.append(ids)
                single[at[chars[at] == n]] = True
            alive = alive[v.prefixes[n].find(h)[0]] if n in v.prefixes else alive[:0]
        # characters without a piece, and bytes of no character: a path of byte pieces
        begins = np.flatnonzero(single)
        inside = np.bincount(begins, minlength=len(own) + 1) - np.bincount(begins + chars[begins], minlength=len(own) + 1)
        spelt = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
        begin, after = np.concatenate([*begin, spelt]), np.concatenate([*after, np.ones(len(spelt), np.int64)])
        piece = np.concatenate([*piece, v.byte_ids[own[spelt]]]).astype(np.int64)
        source = node[begin]
        target = source + after
        depth = target - base[unit[begin]]
        self.end = base + size
        self.base = base
        # forward filtering, one distance from the units' beginnings at a time
        # in one order whatever else is in the slice: a node's edges by their length
        order = np.argsort((depth * (int(self.end[-1]) + 1) + target) * 256 + after)
        self.source, target, self.piece, depth = source[order], target[order], piece[order].astype(np.int32), depth[order]
        self.share = np.empty(len(target))
        self.first = np.zeros(int(self.end[-1]) + 1, np.int64)
        total = np.full(len(self.first), -np.inf)
        total[base] = 0
        group = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        times = np.diff(group, append=len(target))
        self.first[target[group]] = group
        deep = depth[group]
        cut = np.searchsorted(deep, np.arange(deep[-1] + 2)) if len(deep) else []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            a, b, own = group[i], group[j - 1] + times[j - 1], group[i:j] - group[i]
            x = total[self.source[a:b]] + v.weight[self.piece[a:b]]
            most = np.maximum.reduceat(x, own)
            share = np.exp(x - np.repeat(most, times[i:j]))
            part = np.add.reduceat(share, own)
            total[target[group[i:j]]] = most + np.log(part)
            self.share[a:b] = share / np.repeat(part, times[i:j])
        run = np.cumsum(self.share)
        self.share = run - np.repeat(run[group] - self.share[group], times)
        self.share[group + times - 1] = 2  # the last edge of a node takes what rounding leaves


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % 2**64)) >> np.uint64(11)) * 2.0**-53


def encode(v: Vocabulary, texts: list[bytes], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, and how many each has. keys: a uint64 for each row."""
    buf, lengths = join_bytes(texts)
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    start, end, text = _units(buf, lengths)
    first, number = _distinct(buf, start, end)
    lattice = Lattice(v, buf, start[first], end[first])
    ordinal = np.arange(len(start)) - np.searchsorted(text, text)
    key = mix(mix(keys + np.uint64(seed % 2**64))[text] ^ mix(ordinal.astype(np.uint64)))
    left = np.argsort(number, kind="stable")  # equal units together: their edges are near in memory
    at, base, drawn, owner, step = lattice.end[number[left]], lattice.base[number[left]], [], [], 0
    count = np.zeros(len(start), np.int64)
    while len(left):
        u = _uniform(key[left], step)
        edge = lattice.first[at]
        more = np.flatnonzero(lattice.share[edge] < u)
        while len(more):
            edge[more] += 1
            more = more[lattice.share[edge[more]] < u[more]]
        drawn.append(lattice.piece[edge])
        owner.append(left)
        count[left] += 1
        at = lattice.source[edge]
        on = at != base
        left, at, base, step = left[on], at[on], base[on], step + 1
    last = np.cumsum(count) - 1
    out = np.empty(int(last[-1]) + 1, np.int32)
    for k, (o, p) in enumerate(zip(owner, drawn, strict=True)):
        out[last[o] - k] = p
    return out, np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids, whole."""
    size = v.size[ids]
    take = np.repeat(v.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return v.bytes[take].tobytes()


_OUT = "doc_id long, n_pieces long, pieces array<int>, lossless boolean"


def encode_documents(documents: DataFrame, model: str = MODEL, theta: float = 1.0, seed: int = 42) -> DataFrame:
    """doc_id, n_pieces, pieces (sampled ids), lossless (decoding gives back the text) for every document.

    The row key is the doc_id; rows that share it and their text have the same segmentation. A null doc_id
    counts as key 0. Null and empty texts have no pieces. Other columns are ignored; an empty table gives none. A very long text's
    lattice is whole in a task, about 100 bytes for each of its own (one value, so under 2 GB).
    """
    sent = documents.sparkSession.sparkContext.broadcast(load_vocabulary(model, theta))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        v = sent.value
        for batch in batches:
            texts = [x or b"" for x in batch["text"].to_pylist()]
            keys = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in slices(texts, 1 << 19):
                ids, count = encode(v, texts[part], keys[part], seed)
                cut = np.concatenate([[0], np.cumsum(count)])
                back = decode(v, ids)
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(v.size[ids], 0), np.minimum(cut[:-1], len(ids))) * (count > 0))])
                same = [back[a:b] == x for a, b, x in zip(ends[:-1], ends[1:], texts[part], strict=True)]
                pieces = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([batch["doc_id"][part.start : part.stop], pa.array(count), pieces, pa.array(same)], names=["doc_id", "n_pieces", "pieces", "lossless"])

    return bounded(docs).mapInArrow(run, _OUT)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents; null pieces give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches):
        for batch in batches:
            out = [None if p is None else decode(sent.value, np.array(p, np.int64)) for p in batch["pieces"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "text"])

    decoded = bounded(encoded.select("doc_id", "pieces")).mapInArrow(run, "doc_id long, text binary")
    return decoded.select("doc_id", F.col("text").cast("string").alias("text"))  # as bytes so far: all of them come back

"""Removal of long repeats between documents, for words (substring dedup) and bytes (suffix dedup).

A unit (word or byte) goes if a window of `window` units that covers it also starts in a document with
a smaller id. The texts are packed into chunks where they are scanned, written once, and then:

1. Anchors. Words: fixed blocks of each document are the index, all rolling windows of a block's
   length probe it. Bytes: a window's anchor is the least hash among its grams. A chunk sends its distinct
   anchors' short keys to buckets of their range, which answer two bits a key: whether several documents
   have it, and whether one of them has indexed it.
2. Pieces. A window's route is the least of its anchors that hit: equal windows have equal routes. Runs of
   windows of one route are a piece of text. Equal pieces of a chunk are sent once, with their smallest
   document, to the bucket of their route.
3. A bucket brings equal pieces together. Where several pieces share a route, it orders their windows,
   byte for byte. It answers which windows start in a smaller document than their piece's.
4. Chunks mark the units that flagged windows cover.

Hashes only say where a window goes and which can be left out because no other document has its
anchors: whether windows are equal is decided by their bytes. Grams that very many documents hold come
last in the choice of routes (`heavy`), so that a text beside a frequent passage doesn't go to the
passage's bucket; what remains there are the passage's own windows, one entry a chunk. No pair of
documents is ever formed. Chunks and buckets grow with the root of the total, so that a message
from a chunk to a bucket stays worth its row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles, text_bytes
from .hashing import Rolling, join_bytes, mix, word_spans
from .suffix_order import equal_token_windows, equal_windows, same_bytes

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Plan:
    """unit: byte or word. window: units in a repeat. gram: units in a route's gram (words: in a block).

    every: windows go that at least `need` documents have, a column of theirs, from all of them. chunk_bytes and bucket_bytes: None, by the size of the whole.
    """

    unit: str
    window: int
    gram: int
    every: bool = False
    chunk_bytes: int | None = None
    bucket_bytes: int | None = None
    slice_units: int | None = None
    heavy: float = 1e-5  # share of all grams from which a gram is chosen last

    def sized(self, total: int) -> Plan:
        root = math.isqrt(max(0, total))
        chunk = self.chunk_bytes or min(max(4 << 20, 8 * root), 64 << 20)
        bucket = self.bucket_bytes or min(max(6 << 20, 8 * root), 64 << 20)
        return Plan(self.unit, self.window, self.gram, self.every, chunk, bucket, self.slice_units or (1 << 20 if self.unit == "byte" else 1 << 17), self.heavy)


@dataclass
class Units:
    """A chunk's documents one after the other. start, end: of the words in buf; None for bytes."""

    ids: np.ndarray
    texts: list[bytes]
    buf: np.ndarray
    first: np.ndarray  # by document: its first unit
    count: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    need: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.buf) if self.start is None else len(self.start)

    def doc(self, unit: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.count, unit, side="right")

    def whole(self, k: int) -> np.ndarray:
        """By unit: whether k units from here lie in one document."""
        out = np.ones(len(self), bool)
        for first, n in zip(self.first.tolist(), self.count.tolist(), strict=True):
            out[max(first, first + n - k + 1) : first + n] = False
        return out

    def by_document(self, marked: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return run[self.first + self.count] - run[self.first]

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal marked runs, none over a document's end."""
        cut = np.zeros(len(marked) + 1, bool)
        cut[self.first], cut[-1] = True, True
        before = np.r_[False, marked[:-1]] & ~cut[:-1]
        after = np.r_[marked[1:], False] & ~cut[1:]
        return np.flatnonzero(marked & ~before), np.flatnonzero(marked & ~after) + 1


def _units(unit: str, ids: np.ndarray, texts: list[bytes]) -> Units:
    buf, lengths = join_bytes(texts)
    if unit == "byte":
        return Units(ids, texts, buf, np.cumsum(lengths) - lengths, lengths)
    start, end, doc = word_spans(buf, lengths)
    count = np.bincount(doc, minlength=len(texts))
    return Units(ids, texts, buf, np.cumsum(count) - count, count, start, end)


_HASHES: dict[int, Rolling] = {}


def _hash(seed: int) -> Rolling:
    return _HASHES.setdefault(seed, Rolling(seed))


_CODEC = "zstd"


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    raw = b"".join([head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(body: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec=_CODEC, asbytes=True)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a new key starts, of keys in order."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grams(u: Units, plan: Plan) -> Iterator[tuple[int, int, np.ndarray]]:
    """A slice's first unit, its units, and the hashes of all grams that its windows have (over document ends too)."""
    h = _hash(11)
    for a in range(0, len(u), plan.slice_units):
        b = min(len(u), a + plan.slice_units + plan.window - 1)
        if u.start is None:
            codes = h.codes[u.buf[a:b]]
        else:
            low, high = int(u.start[a]), int(u.end[b - 1])
            codes = h.spans(h.prefix(h.codes[u.buf[low:high]]), u.start[a:b] - low, u.end[a:b] - low)
        yield a, min(plan.slice_units, len(u) - a), h.windows(codes, plan.gram)


_CHUNK = pa.schema([("chunk", pa.int64()), ("units", pa.int64()), ("body", pa.binary()), ("grams", pa.binary())])
_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
_SAY = pa.schema([("chunk", pa.int64()), ("anchors", pa.bool_()), ("bucket", pa.int64()), ("bits", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _frequent(u: Units, plan: Plan) -> bytes | None:
    """Grams of a chunk that could be frequent in the whole: a hundredth of its documents' number in a slice."""
    if plan.unit == "word":
        return None
    found, times = [], []
    for _, n, h in _grams(u, plan):
        h = np.sort(h[:n])
        begin = _begins(h)
        count = np.diff(begin, append=len(h))
        least = max(8, n * plan.heavy)
        found.append(h[begin[count >= least]])
        times.append(count[count >= least])
    return _packed(np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *times]))


def _pack(plan: Plan):
    """Chunks of neighbouring documents; a document is never cut. Words are joined by one space."""

    def run(batches):
        task, n = TaskContext.get().partitionId() << 32, 0

        def chunk(ids, texts, needs):
            u = _units(plan.unit, np.array(ids, np.int64), texts)
            body = _packed(u.ids, np.array([len(x) for x in texts], np.int64), np.array(needs, np.int64), u.buf)
            return _rows(_CHUNK, [(task + n, len(u), body, _frequent(u, plan))]).to_batches()

        ids, texts, needs, size = [], [], [], 0
        for batch in batches:
            for i, x, need in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["need"].to_pylist(), strict=True):
                x = x or b""
                ids.append(NO_ID if i is None else i)
                needs.append(need)
                texts.append(b" ".join(x.split()) if plan.unit == "word" else x)
                size += len(x) + 16
                if size >= plan.chunk_bytes:
                    yield from chunk(ids, texts, needs)
                    ids, texts, needs, size, n = [], [], [], 0, n + 1
        if ids:
            yield from chunk(ids, texts, needs)

    return run


def _open(plan: Plan, body: bytes) -> Units:
    ids, lengths, need, buf = _unpacked(body, np.int64, np.int64, np.int64, np.uint8)
    raw, ends = buf.tobytes(), np.cumsum(lengths).tolist()
    u = _units(plan.unit, ids, [raw[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)])
    u.need = need
    return u


# -- anchors -------------------------------------------------------------------------------------------


@dataclass
class Anchors:
    """Distinct keys of a chunk's anchors, in order; number: the key's number of each window or piece (-1: none)."""

    key: np.ndarray
    bucket: np.ndarray
    indexed: np.ndarray
    several: np.ndarray  # several documents of this chunk have it
    number: np.ndarray


def _anchors(key: np.ndarray, ids: np.ndarray, indexed: np.ndarray, buckets: int) -> Anchors:
    order = np.argsort(key)
    begin = _begins(key[order])
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(key)))
    if not len(begin):
        none = np.zeros(0, bool)
        return Anchors(key, key.astype(np.int64), none, none, number)
    who, key = ids[order], key[order][begin]
    several = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
    return Anchors(key, _bucket_of(key, buckets), np.logical_or.reduceat(indexed[order], begin), several, number)


def _word_anchors(u: Units, plan: Plan, buckets: int) -> tuple[Anchors, np.ndarray]:
    """Blocks that start at each word, as probes and, at every block's length, as the index; and their hashes by word."""
    h = np.concatenate([np.zeros(0, np.uint64), *(part[:n] for _, n, part in _grams(u, plan))])
    h = np.append(h, np.zeros(len(u) - len(h), np.uint64))
    at = np.flatnonzero(u.whole(plan.gram))
    doc = u.doc(at)
    found = _anchors(h[at], u.ids[doc], (at - u.first[doc]) % plan.gram == 0, buckets)
    number = np.full(len(u), -1, np.int64)
    number[at] = found.number
    found.number = number
    return found, h


def _byte_anchors(u: Units, plan: Plan, buckets: int, heavy: Heavy) -> tuple[Anchors, tuple[np.ndarray, ...]]:
    """Routes of all windows; and the runs of windows of one route: first window, windows, route."""
    inner, whole = plan.window - plan.gram + 1, u.whole(plan.window)
    runs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, n, h in _grams(u, plan):
        part = _least_within(heavy.last(h), inner) if len(h) >= inner else h[:0]
        part = np.append(part, np.zeros(max(0, n - len(part)), np.uint64))[:n]
        runs.append(_same_route(part, whole[a : a + n], a))
    at, long, route = (np.concatenate(x) for x in zip(*runs, strict=True))
    return _anchors(mix(route), u.ids[u.doc(at)], np.ones(len(at), bool), buckets), (at, long, route)


def _same_route(route: np.ndarray, ok: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one route: the first, how many, the route."""
    new, end = ok.copy(), ok.copy()
    new[1:] &= ~ok[:-1] | (route[1:] != route[:-1])
    end[:-1] &= ~ok[1:] | (route[1:] != route[:-1])
    begin = np.flatnonzero(new)
    return begin + offset, np.flatnonzero(end) + 1 - begin, route[begin]


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the key."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = [*_begins(bucket).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


def _ask_anchors(plan: Plan, buckets: int, heavy: np.ndarray):
    def run(batches):
        table = Heavy(heavy)
        for batch in batches:
            for chunk, body in zip(batch["chunk"].to_pylist(), batch["body"].to_pylist(), strict=True):
                u = _open(plan, body)
                p = (_word_anchors(u, plan, buckets) if plan.unit == "word" else _byte_anchors(u, plan, buckets, table))[0]
                out = []
                for b, s in _by_bucket(p.bucket):
                    # within a bucket the keys' upper halves hardly differ: 32 mixed bits tell them apart
                    short = (mix(p.key[s]) >> np.uint64(32)).astype(np.uint32)
                    flags = np.packbits(np.concatenate([p.indexed[s], p.several[s]]))
                    out.append((b, chunk, np.int64(len(short)).tobytes() + short.tobytes() + flags.tobytes()))
                yield from _rows(_ASK, out).to_batches()

    return run


def _answer_anchors(t: pa.Table) -> pa.Table:
    """Of each key: whether several documents have it, and whether one of these has indexed it."""
    keys, indexed, several = [], [], []
    for body in t["body"].to_pylist():
        n = int(np.frombuffer(body, np.int64, 1)[0])
        keys.append(np.frombuffer(body, np.uint32, n, 8))
        flags = np.unpackbits(np.frombuffer(body, np.uint8, offset=8 + 4 * n), count=2 * n).astype(bool)
        indexed.append(flags[:n])
        several.append(flags[n:])
    size = [len(k) for k in keys]
    key, indexed, several = np.concatenate(keys), np.concatenate(indexed), np.concatenate(several)
    order = np.argsort(key)
    begin = _begins(key[order])
    times = np.diff(begin, append=len(key))
    shared = (times > 1) | np.logical_or.reduceat(several[order], begin)
    hit = shared & np.logical_or.reduceat(indexed[order], begin)
    out_shared, out_hit = np.empty(len(key), bool), np.empty(len(key), bool)
    out_shared[order], out_hit[order] = np.repeat(shared, times), np.repeat(hit, times)
    rows, at, bucket = [], 0, t["bucket"][0].as_py()
    for chunk, n in zip(t["chunk"].to_pylist(), size, strict=True):
        part = out_shared[at : at + n]
        if part.any():
            rows.append((chunk, True, bucket, np.packbits(np.concatenate([part, out_hit[at : at + n]])).tobytes()))
        at += n
    return _rows(_SAY, rows)


def _anchor_bits(p: Anchors, said: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    shared, hit = np.zeros(len(p.key), bool), np.zeros(len(p.key), bool)
    for b, s in _by_bucket(p.bucket):
        if b in said:
            n = s.stop - s.start
            bits = np.unpackbits(np.frombuffer(said[b], np.uint8), count=2 * n).astype(bool)
            shared[s], hit[s] = bits[:n], bits[n:]
    return shared, hit


# -- pieces --------------------------------------------------------------------------------------------


def _least_within(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    step, out = 1, x
    while 2 * step <= k:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = k - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Heavy:
    """Frequent grams: a small table of bits first, then a search."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def last(self, h: np.ndarray) -> np.ndarray:
        """The hashes in another order: frequent ones after all others."""
        h = h >> np.uint64(1)
        if len(self.grams):
            at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            at = at[self.grams[found] == h[at]]
            h[at] |= np.uint64(1 << 63)
        return h


@dataclass
class Pieces:
    """Distinct pieces of a chunk by bucket and route, and all their occurrences.

    Of a distinct piece: route, bucket, an occurrence's first unit, windows, smallest id (every: what it
    needs), and for `every` how many documents have it.
    Of an occurrence: first unit, windows, id, number of its distinct piece.
    """

    route: np.ndarray
    bucket: np.ndarray
    unit: np.ndarray
    windows: np.ndarray
    least: np.ndarray
    docs: np.ndarray
    at: np.ndarray
    long: np.ndarray
    id: np.ndarray
    number: np.ndarray


def _span(u: Units, plan: Plan, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A piece's first byte and its length."""
    last = at + windows + plan.window - 2
    if u.start is None:
        return at, last + 1 - at
    return u.start[at], u.end[last] - u.start[at]


def _pieces(u: Units, plan: Plan, buckets: int, anchor_buckets: int, heavy: Heavy, said: dict[int, bytes]) -> Pieces:
    if plan.unit == "word":
        p, h = _word_anchors(u, plan, anchor_buckets)
        shared, hit = (np.append(x, False)[p.number] for x in _anchor_bits(p, said))
        # a window is live if other documents have all its blocks and have indexed one; the least of these is its route
        inner, no = plan.window - plan.gram + 1, np.uint64(2**64 - 1)
        least = _least_within(np.where(hit, h >> np.uint64(1), no), inner)
        dead = _least_within(shared.astype(np.uint8), inner) == 0
        least = np.append(least, np.full(len(u) - len(least), no))
        dead = np.append(dead, np.ones(len(u) - len(dead), bool))
        at, long, route = _same_route(least, u.whole(plan.window) & ~dead & (least != no), 0)
    else:
        p, (at, long, route) = _byte_anchors(u, plan, anchor_buckets, heavy)
        live = _anchor_bits(p, said)[0][p.number]
        at, long, route = at[live], long[live], route[live]
    low, size = _span(u, plan, at, long)
    content = _hash(12).stretches(u.buf, low, size)
    bucket = _bucket_of(mix(route), buckets)
    order = np.lexsort((size, content, route, bucket))
    at, long, route, content, bucket, low, size = (x[order] for x in (at, long, route, content, bucket, low, size))
    begin = _begins(bucket, route, content, size)
    times = np.diff(begin, append=len(at))
    number = np.repeat(np.arange(len(begin)), times)
    # of equal hashes only equal bytes are one piece
    if not same_bytes(u.buf, low[begin][number], low, size).all():
        number, begin = _apart(u.buf, low, size, begin)
    doc = u.doc(at)
    ids, least, docs = u.ids[doc], np.full(len(begin), NO_ID), np.zeros(0, np.int64)
    np.minimum.at(least, number, u.need[doc] if plan.every else ids)
    if plan.every:
        held = np.unique(number * len(u.ids) + doc)
        docs = np.bincount(held // len(u.ids), minlength=len(begin))
        again = _said_again(u, plan, route[begin], at[begin], long[begin], held // len(u.ids), held % len(u.ids))
        if again:
            return _with_again(Pieces(route[begin], bucket[begin], at[begin], long[begin], least, docs, at, long, ids, number), again)
    return Pieces(route[begin], bucket[begin], at[begin], long[begin], least, docs, at, long, ids, number)


def _said_again(u: Units, plan: Plan, route: np.ndarray, unit: np.ndarray, windows: np.ndarray, piece: np.ndarray, doc: np.ndarray) -> Counter:
    """Runs of windows that documents have in an earlier piece of the same route already: (piece, first window, windows), and in how many documents.

    piece, doc: which documents have which of the distinct pieces.
    """
    out = Counter()
    order = np.lexsort((piece, route[piece], doc))
    piece, doc = piece[order], doc[order]
    begin = _begins(doc, route[piece])
    count = np.diff(begin, append=len(piece))
    for a, n in zip(begin[count > 1].tolist(), count[count > 1].tolist(), strict=True):
        seen: set[bytes] = set()
        for j in piece[a : a + n].tolist():
            low = unit[j] + np.arange(windows[j])
            own = [u.buf[x:y].tobytes() for x, y in zip(u.start[low].tolist(), u.end[low + plan.window - 1].tolist(), strict=True)]
            old = np.array([False, *(w in seen for w in own), False])
            edges = np.flatnonzero(old[1:] != old[:-1]).tolist()
            out.update((j, x, y - x) for x, y in zip(edges[::2], edges[1::2], strict=True))
            seen.update(own)
    return out


def _with_again(p: Pieces, again: Counter) -> Pieces:
    """The same with entries that take back what several pieces of one document count twice; these are never flagged."""
    j, first, long = np.array(list(again), np.int64).T
    n = len(p.route)
    bucket = np.concatenate([p.bucket, p.bucket[j]])
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    columns = (
        (p.route, p.route[j]), (p.bucket, p.bucket[j]), (p.unit, p.unit[j] + first), (p.windows, long),
        (p.least, np.full(len(j), NO_ID)), (p.docs, -np.array(list(again.values()), np.int64)),
    )
    return Pieces(*(np.concatenate(c)[order] for c in columns), p.at, p.long, p.id, place[:n][p.number])


def _apart(buf: np.ndarray, low: np.ndarray, size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and first occurrences of distinct pieces where equal hashes hide different bytes."""
    number, first = np.empty(len(low), np.int64), []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(low)], strict=True):
        seen: dict[bytes, int] = {}
        for i in range(a, b):
            text = buf[low[i] : low[i] + size[i]].tobytes()
            if text not in seen:
                seen[text] = len(first)
                first.append(i)
            number[i] = seen[text]
    return number, np.array(first, np.int64)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of the same rank together, so that the high ones compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).reshape(-1)


def _unplanes(x: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _message(u: Units, plan: Plan, p: Pieces, s: slice) -> bytes:
    low, size = _span(u, plan, p.unit[s], p.windows[s])
    begin = np.cumsum(size) - size
    take = np.repeat(low - begin, size) + np.arange(int(size.sum()))
    route = (mix(p.route[s]) & np.uint64(2**32 - 1)).astype(np.uint32)
    return _packed(route, _planes(size.astype(np.uint32)), _planes(p.least[s]), _planes(p.docs[s]) if plan.every else np.zeros(0, np.uint8), u.buf[take])


def _send(plan: Plan, chunk: int, u: Units, p: Pieces) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for b, s in _by_bucket(p.bucket):
        out.append((b, chunk, _message(u, plan, p, s)))
        size += len(out[-1][2])
        if size > 4 << 20:
            yield from _rows(_ASK, out).to_batches()
            out, size = [], 0
    yield from _rows(_ASK, out).to_batches()


def _ask_windows(plan: Plan, buckets: int, anchor_buckets: int, heavy: np.ndarray):
    def ask(chunks: pa.Table, said: pa.Table) -> pa.Table:
        if not chunks.num_rows or not said.num_rows:
            return _ASK.empty_table()
        u = _open(plan, chunks["body"][0].as_py())
        heard = dict(zip(said["bucket"].to_pylist(), said["bits"].to_pylist(), strict=True))
        parts = list(_send(plan, chunks["chunk"][0].as_py(), u, _pieces(u, plan, buckets, anchor_buckets, Heavy(heavy), heard)))
        return pa.Table.from_batches(parts, schema=_ASK)

    return ask


def _distinct(buf: np.ndarray, low: np.ndarray, size: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces by route: an entry of each; and each entry's piece. Hashes bring equal ones together, bytes decide."""
    content = _hash(12).stretches(buf, low, size)
    order = np.lexsort((size, content, route))
    begin = _begins(route[order], content[order], size[order])
    number = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(order)))
    if not same_bytes(buf, low[order[begin]][number], low[order], size[order]).all():
        number, begin = _apart(buf, low[order], size[order], begin)
    piece = np.empty(len(order), np.int64)
    piece[order] = number
    return order[begin], piece


def _by_window(plan: Plan, buf: np.ndarray, low: np.ndarray, size: np.ndarray, windows: np.ndarray, route: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each window of distinct pieces, by route: the least value of the pieces that have it (every: their sum)."""
    out = np.repeat(value, windows)
    begin = _begins(route)
    several = np.repeat(np.diff(begin, append=len(route)) > 1, np.diff(begin, append=len(route)))
    some = np.flatnonzero(several)  # a route's only piece has its windows for itself
    if not len(some):
        return out
    n, m = size[some], windows[some]
    own = np.cumsum(n) - n
    text = buf[np.repeat(low[some] - own, n) + np.arange(int(n.sum()))]
    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    at = np.repeat((np.cumsum(windows) - windows)[some], m) + inner
    if plan.unit == "byte":
        start, long = np.repeat(own, m) + inner, plan.window
    else:
        begins, ends, piece = word_spans(text, n)
        word = np.repeat(np.searchsorted(piece, np.arange(len(n))), m) + inner
        start = begins[word]
        long = ends[word + plan.window - 1] - start
    if plan.every:
        order, begin = equal_token_windows(text, begins, ends, piece, word, plan.window)
        group = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(order)))
        values = np.zeros(len(order), np.int64)
        # a piece that has a window twice has it once
        once = np.unique(group * len(route) + np.repeat(some, m)[order], return_index=True)[1]
        values[once] = np.repeat(value[some], m)[order][once]
    else:
        order, begin = equal_windows(text, own, n, start, long)
        values = np.repeat(value[some], m)[order]
    out[at[order]] = np.repeat((np.add if plan.every else np.minimum).reduceat(values, begin), np.diff(begin, append=len(order)))
    return out


def _answer(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """A window is flagged if a smaller id than its piece's smallest has it (every: if as many documents have it as are needed)."""

    def answer(t: pa.Table) -> pa.Table:
        parts = [_unpacked(body, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8) for body in t["body"].to_pylist()]
        entries = np.array([len(x[0]) for x in parts])
        route, buf = (np.concatenate([x[i] for x in parts]) for i in (0, 4))
        size = np.concatenate([_unplanes(x[1], np.uint32) for x in parts]).astype(np.int64)
        least = np.concatenate([_unplanes(x[2], np.int64) for x in parts])
        docs = np.concatenate([_unplanes(x[3], np.int64) for x in parts])
        del parts
        windows = (size if plan.unit == "byte" else np.bincount(word_spans(buf, size)[2], minlength=len(size))) - plan.window + 1
        counts = np.add.reduceat(windows, np.cumsum(entries) - entries).tolist()
        low = np.cumsum(size) - size
        first, piece = _distinct(buf, low, size, route)
        # of a distinct piece: its smallest id (every: what it needs) and how many documents have it
        lowest, number = np.full(len(first), NO_ID), np.zeros(len(first), np.int64)
        np.minimum.at(lowest, piece, least)
        if plan.every:
            np.add.at(number, piece, docs)
        found = _by_window(plan, buf, low[first], size[first], windows[first], route[first], number if plan.every else lowest)
        # back from pieces to entries
        begin = (np.cumsum(windows[first]) - windows[first])[piece]
        at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        flag = found[at] >= np.repeat(least, windows) if plan.every else found[at] < np.repeat(least, windows)
        rows, a, bucket = [], 0, t["bucket"][0].as_py()
        for chunk, n in zip(t["chunk"].to_pylist(), counts, strict=True):
            if flag[a : a + n].any():
                rows.append((chunk, False, bucket, np.packbits(flag[a : a + n]).tobytes()))
            a += n
        return _rows(_SAY, rows)

    return answer


def _cover(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Marks [start, stop) for each pair."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(stops, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def _gone(u: Units, plan: Plan, p: Pieces, said: dict[int, bytes]) -> np.ndarray:
    """By unit: whether a flagged window covers it."""
    bits = np.zeros(int(p.windows.sum()), bool)
    first = np.cumsum(p.windows) - p.windows
    for b, s in _by_bucket(p.bucket):
        if b in said:
            a, z = first[s.start], first[s.stop - 1] + p.windows[s.stop - 1]
            bits[a:z] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=z - a)
    own = np.zeros(len(p.at), bool) if plan.every else p.id > p.least[p.number]
    starts = [p.at[own]]
    stops = [p.at[own] + p.long[own] + plan.window - 1]
    rest = np.flatnonzero(~own & (np.add.reduceat(bits, first, dtype=np.int64) > 0)[p.number]) if len(first) else np.zeros(0, np.int64)
    if len(rest):
        m = p.long[rest]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        flagged = np.flatnonzero(bits[np.repeat(first[p.number[rest]], m) + inner])
        at = (np.repeat(p.at[rest], m) + inner)[flagged]
        starts.append(at)
        stops.append(at + plan.window)
    return _cover(len(u), np.concatenate(starts), np.concatenate(stops))


def _finish(plan: Plan, buckets: int, anchor_buckets: int, heavy: np.ndarray, finish: Callable, schema: pa.Schema):
    def last(chunks: pa.Table, said: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return schema.empty_table()
        u = _open(plan, chunks["body"][0].as_py())
        heard: dict[bool, dict[int, bytes]] = {True: {}, False: {}}
        for kind, b, bits in zip(said["anchors"].to_pylist(), said["bucket"].to_pylist(), said["bits"].to_pylist(), strict=True):
            heard[kind][b] = bits
        p = _pieces(u, plan, buckets, anchor_buckets, Heavy(heavy), heard[True])
        ids = [None if i == NO_ID else i for i in u.ids.tolist()]
        return finish(u, ids, _gone(u, plan, p, heard[False]))

    return last


def _heavy_grams(chunks: DataFrame, plan: Plan, total: int) -> np.ndarray:
    """Grams that make up at least plan.heavy of all: at most 1 / plan.heavy of them, so they may be collected and broadcast."""

    def each(batches):
        for batch in batches:
            for body in batch["grams"].to_pylist():
                h, n = _unpacked(body, np.uint64, np.int64)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["gram", "n"])

    found = chunks.select("grams").mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= max(64.0, total * plan.heavy)).select("gram").collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64) >> np.uint64(1)


def remove_repeats(documents: DataFrame, plan: Plan, finish: Callable, schema: pa.Schema) -> DataFrame:
    """finish(units, ids, gone): columns of `schema` for a chunk; gone: a mark by unit.

    Null texts are empty; rows of a null id count as after all others, and rows of one id as one document.
    """
    spark = documents.sparkSession
    plan = plan.sized(text_bytes(documents))
    need = F.col("need") if plan.every else F.lit(0).cast("long").alias("need")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), need)
    written = Written(bounded(docs).mapInArrow(_pack(plan), _ddl(_CHUNK)), "chunks", **{"parquet.block.size": str(16 << 20)})
    total = written.read().agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    chunks = bounded(written.read().select("chunk", "body"))
    heavy = _heavy_grams(written.read(), plan, total) if plan.unit == "byte" else np.zeros(0, np.uint64)
    # an anchor's key is 4 bytes, one for each word or 18 bytes; a piece of text is four times what it adds, a third of the text may be live
    anchor_buckets, buckets = (max(4, math.ceil(x * total / plan.bucket_bytes)) for x in ((4, 8) if plan.unit == "word" else (0.25, 2)))
    asked = chunks.mapInArrow(_ask_anchors(plan, anchor_buckets, heavy), _ddl(_ASK))
    anchors = Written(asked.groupBy("bucket").applyInArrow(_answer_anchors, _ddl(_SAY)), "anchors")
    del asked
    free_shuffles(spark)
    asked = chunks.groupBy("chunk").cogroup(anchors.read().groupBy("chunk")).applyInArrow(_ask_windows(plan, buckets, anchor_buckets, heavy), _ddl(_ASK))
    found = Written(asked.groupBy("bucket").applyInArrow(_answer(plan), _ddl(_SAY)), "flags")
    del asked
    free_shuffles(spark)
    said = found.read().unionAll(anchors.read())
    return chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_finish(plan, buckets, anchor_buckets, heavy, finish, schema), _ddl(schema))

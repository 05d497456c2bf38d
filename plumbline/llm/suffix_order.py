"""Equal windows of a bucket's pieces of text, by their bytes.

Byte windows: a blockwise suffix sort with a difference cover. Positions whose place in their piece is in
the cover modulo 21 are samples; these are ranked once, by at most `window` bytes. The suffixes that
start a window are then sorted by their first 24 bytes, and ties are split around pivots: for any two
places an offset below 21 moves both into the cover, where the precomputed ranks say which comes first. So
no comparison goes deeper than 24 bytes, however long the repeats are. Neighbours in the order that share
a window's bytes are equal windows.

Word windows have their own lengths: they are grouped by hash, and each is held byte for byte against
its group's first. Token windows (runs that many documents of a host share) come from a suffix array of the token
streams: tokens are numbered by their bytes, and suffixes are ranked by prefix doubling to the window's depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashing import Rolling, mix

#: A perfect difference set modulo 21; all differences occur.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: By two places modulo the period: the least offset that moves both into the cover.
OFFSET = np.array([[min(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
_HEAD = 3  # eight-byte words that are compared before ranks


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each pair of stretches of one size: whether their bytes are equal."""
    out = a == b
    todo = np.flatnonzero(~out)
    if len(todo):
        word = eight_bytes(buf)
        out[todo] = same_words(word, a[todo], word, b[todo], size[todo])
    return out


def same_words(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for stretches of two buffers, given as eight_bytes: pairs drop out at their first difference or their end."""
    out = np.zeros(len(a), bool)
    todo, at = np.arange(len(a)), np.zeros(len(a), np.int64)
    while len(todo):
        rest = size[todo] - at
        shift = (8 - np.clip(rest, 1, 8)).astype(np.uint64) * np.uint64(8)
        equal = ((one[a[todo] + at] ^ other[b[todo] + at]) >> shift == 0) | (rest <= 0)
        done = equal & (rest <= 8)
        out[todo[done]] = True
        on = equal & ~done
        todo, at = todo[on], at[on] + 8
    return out


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """By position: the eight bytes from there on as a number that sorts like them; zeros after the end."""
    x = np.concatenate([buf, np.zeros(15, np.uint8)]).astype(np.uint16)
    x = x[:-1] << np.uint16(8) | x[1:]
    x = x[:-2].astype(np.uint32) << np.uint32(16) | x[2:]
    return x[:-4].astype(np.uint64) << np.uint64(32) | x[4:]


def sample_ranks(word: np.ndarray, low: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """By position: the rank of the cover samples by their first `depth` bytes or those up to their piece's end, -1 elsewhere."""
    n = int(size.sum())
    place = np.arange(n) - np.repeat(low, size)
    at = np.flatnonzero(np.isin(place % PERIOD, COVER))
    rest = np.minimum(np.repeat(low + size, size)[at] - at, depth)
    keys = []
    for k in range(0, depth, 8):
        left = np.clip(rest - k, 0, 8)
        x = word[np.minimum(at + k, n)]
        keys.append(np.where(left > 0, x & ~(np.uint64(2**64 - 1) >> np.minimum(8 * left, 63).astype(np.uint64)) | np.where(left == 8, x, 0), 0).astype(np.uint64))
    keys.append(rest.astype(np.uint64))
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.full(n, -1, np.int32)
    rank[at[order]] = np.cumsum(new)
    return rank


def suffix_order(text: np.ndarray, low: np.ndarray, size: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `start` (of their pieces, at `low`), right for `depth` bytes at least; and the words of the text."""
    word = np.concatenate([eight_bytes(text), np.zeros(depth + 8, np.uint64)])
    keys = [word[start + 8 * k] for k in range(_HEAD)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(start), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    del keys
    begin = np.flatnonzero(new)
    count = np.diff(begin, append=len(start))
    begin, count = begin[count > 1], count[count > 1]
    if not len(begin):
        return order, word
    rank = sample_ranks(word, low, size, depth)
    place = (start - low[np.searchsorted(low, start, side="right") - 1]) % PERIOD
    turn = 0
    while len(begin):
        group = np.repeat(np.arange(len(begin)), count)
        at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + begin[group]
        one = order[at]
        pick = (mix(begin.astype(np.uint64) + np.uint64(turn)) % count.astype(np.uint64)).astype(np.int64)
        other = order[begin + pick][group]
        offset = OFFSET[place[one], place[other]]
        side = np.sign(rank[start[one] + offset].astype(np.int64) - rank[start[other] + offset]) + 1
        key = group * 3 + side
        order[at] = one[np.argsort(key, kind="stable")]
        part = np.bincount(key, minlength=3 * len(begin)).reshape(-1, 3)
        begin, count = np.concatenate([begin, begin + part[:, 0] + part[:, 1]]), np.concatenate([part[:, 0], part[:, 2]])
        begin, count = begin[count > 1], count[count > 1]
        turn += 1
    return order, word


def equal_windows(text: np.ndarray, low: np.ndarray, size: np.ndarray, start: np.ndarray, long: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones are neighbours, and where in it another window begins.

    low, size: the pieces in text; start: the windows; long: their length, one for all (bytes) or each its own.
    """
    if isinstance(long, int):
        if long < 8 * _HEAD + PERIOD:
            raise ValueError(f"windows must be of {8 * _HEAD + PERIOD} bytes at least")
        order, word = suffix_order(text, low, size, start, long)
        at = start[order]
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k in [*range(0, long - 7, 8), long - 8]:
            x = word[at + k]
            new[1:] |= x[1:] != x[:-1]
        return order, np.flatnonzero(new)
    key = Rolling(14).stretches(text, start, long)
    order = np.lexsort((long, key))
    begin_all, todo, out = [], order, []
    while len(todo):
        k, n = key[todo], long[todo]
        new = np.ones(len(todo), bool)
        new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        first = todo[new][np.cumsum(new) - 1]
        same = same_bytes(text, start[first], start[todo], n)
        begin_all.append(np.flatnonzero(new[same]) + sum(map(len, out)))
        out.append(todo[same])
        todo = todo[~same]  # equal hashes of different bytes: groups of their own
    return np.concatenate([order[:0], *out]), np.concatenate([np.zeros(0, np.int64), *begin_all])


def token_suffix_ranks(token: np.ndarray, stream: np.ndarray, depth: int) -> np.ndarray:
    """By place: the rank of the suffix there among all, by its first `depth` tokens; none goes beyond its stream, and a shorter one comes first."""
    rank, known = token.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        behind = np.zeros(len(rank), np.int64)
        same = stream[step:] == stream[:-step]
        behind[: len(same)] = np.where(same, rank[step:] + 1, 0)
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + behind, return_inverse=True)[1]
        known += step
    return rank


def equal_token_windows(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, stream: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `depth` tokens at the places `at` in suffix order, and where in it a window begins that its neighbour before isn't equal to.

    begins, ends, stream: each token's first byte, its end, and the stream it belongs to.
    """
    size = ends - begins
    low = np.concatenate([[0], np.cumsum(size)])
    packed = text[np.repeat(begins - low[:-1], size) + np.arange(int(low[-1]))]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(low.astype(np.int64)), pa.py_buffer(packed)])
    rank = token_suffix_ranks(words.dictionary_encode().indices.to_numpy(), stream, depth)[at]
    order = np.argsort(rank, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    return order, np.flatnonzero(new)

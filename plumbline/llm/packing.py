"""Packing of tokenised documents into sequences of one length by best-fit decreasing.

A document longer than a window is first cut into full windows, each a sequence of its own; these are named where the
document is read and never shuffled. What is left of each document is dealt into groups of a few thousand pieces by
hash, and a task packs a group: longest piece first, each into the open window that it leaves fullest. Open
windows hang at the leaves of a segment tree, one leaf for each remaining capacity, so the tightest is found in a
walk of its height. Where pieces don't fit together (say all are a little over half a window), the emptiest windows
are taken apart at the end and their pieces cut to fill the others, so a group has one window with more than `slack` places free.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
_CUT = pa.schema([*_FIELDS, ("ordinal", pa.int64()), ("ids", pa.binary())])
_OUT = pa.schema(_FIELDS)


#: Marks that are a unit of their own behind a letter or digit, and Latin letters that are normal already but for
#: capitals (without the one whose lower case is two characters).
_MARKS = ".,!?;:"
_LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įıĲ-ɏ]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable and no space, else the next one from U+0100 on."""
    shown = [b for b in range(256) if b in range(0x21, 0x7F) or b in range(0xA1, 0x100) and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts by whole words between ASCII white space, each distinct word encoded once.

    The tokenizer of `path` must drop white space and look at no word's neighbours; it takes marks behind a letter or
    digit as a unit of their own. The table of words starts anew when it has more than `cache`. latin: it lower-cases, and Latin
    letters are one unit of byte letters, so its merges are asked directly, without its patterns.
    """

    def __init__(self, path: str, cache: int = 1 << 19, latin: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters = self.tokenizer.model, _byte_letters()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache, self.latin = cache, latin
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _merged(self, x: str) -> list[int]:
        x = x.lower()
        return [t.id for t in self.merges.tokenize(x if x.isascii() else "".join(map(self.letters.__getitem__, x.encode())))]

    def _learn(self, words: list[str]) -> np.ndarray:
        """The words' numbers."""
        if len(self.known) > self.cache:
            self._clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            # strings of letters alone, then all others in calls of a thousand
            plain = [self.latin and (w.isalpha() if w.isascii() else _LATIN.fullmatch(w) is not None) for w in new]
            others = [w for w, p in zip(new, plain, strict=True) if not p]
            full = iter([e.ids for a in range(0, len(others), 1024) for e in self.tokenizer.encode_batch_fast(others[a : a + 1024], add_special_tokens=False)])
            ids = [self._merged(w) if p else next(full) for w, p in zip(new, plain, strict=True)]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.kind)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words, and the mark behind each that is a unit of its own (0: none), which its word is then without."""
        stems = pc.utf8_rtrim(words, _MARKS)
        size = pc.binary_length(stems).to_numpy()
        one = pc.binary_length(words).to_numpy() - size == 1
        if not one.any():
            return words, np.zeros(len(words), np.uint8)
        _, offsets, body = stems.buffers()
        body = np.frombuffer(body, np.uint8)
        last = body[np.frombuffer(offsets, np.int64, len(stems) + 1, 8 * stems.offset)[1:] - 1]  # of an empty one another's, which isn't used
        letter, digit = (last | 32 >= ord("a")) & (last | 32 <= ord("z")), (last >= ord("0")) & (last <= ord("9"))
        own = one & (size > 0) & (letter | digit)
        _, offsets, body = words.buffers()
        mark = np.frombuffer(body, np.uint8)[np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)[1:] - 1]
        return pc.if_else(pa.array(own), stems, words), np.where(own, mark, 0)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and where those of each word end."""
        stems, marks = self._stems(words)
        coded = stems.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self._learn([*distinct, *_MARKS])
        unit = np.empty(2 * len(words), np.int64)
        unit[::2] = number[coded.indices.to_numpy()]
        behind = np.zeros(256, np.int64)
        behind[[ord(m) for m in _MARKS]] = number[len(distinct) :]
        unit[1::2] = behind[marks]
        sizes = self.starts[unit + 1] - self.starts[unit]
        sizes[1::2][marks == 0] = 0
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[unit] - (ends - sizes), sizes) + np.arange(ends[-1])], ends[1::2]

    def __call__(self, texts: pa.Array, slice_words: int = 1 << 18) -> list[list[np.ndarray]]:
        """Each text's ids, as a list of arrays."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds, values = words.offsets.to_numpy(), words.values
        parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        for a in range(0, len(values), slice_words):
            ids, ends = self._encode(values.slice(a, slice_words))
            first, last = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, a + len(ends), "left")
            for t in range(max(first, 0), min(last, len(texts))):
                lo, hi = max(bounds[t], a) - a, min(bounds[t + 1], a + len(ends)) - a
                if hi > lo:
                    parts[t].append(ids[ends[lo - 1] if lo else 0 : ends[hi - 1]])
        return parts


#: A worker's tables, kept from task to task.
_TABLES: dict[str, WordIds] = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(path: str, window: int, end: int):
    """Full windows as sequences of their own; the rest of a document with its ids."""

    def run(batches):
        if path not in _TABLES:
            _TABLES[path] = WordIds(path)
        encode = _TABLES[path]
        part, ordinal, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = [[] for _ in _CUT]
            for doc, parts in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                ids = np.concatenate([*parts, np.array([end], encode.kind)])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    whole = len(piece) == window
                    row = doc, start, len(piece), crc(piece), len(ids), (part << 36 | full) * 2 if whole else None, 0, ordinal, None if whole else piece.tobytes()
                    full += whole
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                ordinal += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _CUT, strict=True)], schema=_CUT)

    return run


class Windows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, name: int) -> None:
        if not capacity:
            return
        self.at[capacity].append(name)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of `need` or more, and that capacity."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:  # no subtree to the right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, first, length), pieces given longest first; a piece is cut only to fill windows at the end."""
    open_windows, windows = Windows(window), []
    for piece, length in enumerate(lengths):
        found = open_windows.take(length)
        name, capacity = found or (len(windows), window)
        if not found:
            windows.append([])
        windows[name].append((piece, 0, length))
        open_windows.put(capacity - length, name)
    used = [sum(n for _, _, n in w) for w in windows]
    order = sorted((i for i, n in enumerate(used) if window - n > slack), key=lambda i: (-used[i], i))
    first, last, rest = 0, len(order) - 1, []
    while first < last:
        if not rest:  # the emptiest window is taken apart
            rest, windows[order[last]], used[order[last]] = windows[order[last]], [], 0
            last -= 1
        while rest and first <= last:
            piece, at, n = rest.pop()
            put = min(n, window - used[order[first]])
            windows[order[first]].append((piece, at, put))
            used[order[first]] += put
            if put < n:
                rest.append((piece, at + put, n - put))
            first += window - used[order[first]] <= slack
    if rest:  # what no other window has room for
        windows[order[last + 1]] = rest
    return [w for w in windows if w]


def _pack(window: int, slack: int):
    def run(table: pa.Table) -> pa.Table:
        group = table["bucket"][0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("ordinal", "ascending")])
        docs, starts, lengths, crcs, totals, ids = (table[c].to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
        rows = []
        for name, pieces in enumerate(best_fit(lengths, window, slack)):
            offset = 0
            for i, at, n in pieces:
                if n == lengths[i]:
                    digest = crcs[i]
                else:
                    width = len(ids[i]) // lengths[i]
                    digest = crc(np.frombuffer(ids[i], f"u{width}", n, at * width))
                rows.append((docs[i], starts[i] + at, n, digest, totals[i], (group << 36 | name) * 2 + 1, offset))
                offset += n
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def pack_documents(documents: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, pieces: int = 4096, slack: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document's ids.

    A document's ids are those of its whole text and then `end`; a null or empty text has `end` alone. Each id is in one
    piece. A sequence has pieces of at most `window` ids in all, gapless from offset 0. Rows with a null doc_id and
    repeated rows are documents of their own. Pieces of equal length go by doc_id, digest and place in the input. An empty table gives no
    rows; other columns are ignored. pieces: how many a task packs. slack: how much of a window may stay free before pieces are
    cut to fill it; one window a group has more. A text is one value, so under 2 GB; its ids are held as 2 or 4 bytes each.
    """
    if window < 1 or pieces < 1 or slack < 0:
        raise ValueError("window and pieces must be positive, slack not negative")
    docs = bounded(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "2m")
    cut = Written(docs.mapInArrow(_cut(tokenizer, window, end), f"{_PIECE}, ordinal long, ids binary"), "pieces").read()
    rest = cut.where("sequence_id is null")
    groups = max(1, math.ceil(rest.count() / pieces))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ordinal", "ids_crc32"), F.lit(groups)))
    packed = rest.groupBy("bucket").applyInArrow(_pack(window, slack), _PIECE)
    return cut.where("sequence_id is not null").select(*_OUT.names).unionByName(packed)

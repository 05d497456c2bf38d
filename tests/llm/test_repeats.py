"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.hashing import Rolling, word_spans
from plumbline.llm.repeats import _apart, _units
from plumbline.llm.substring_dedup import kept_texts, substring_dedup
from plumbline.llm.suffix_dedup import removed_spans, suffix_dedup
from plumbline.llm.suffix_order import COVER, OFFSET, PERIOD, equal_windows, same_bytes, suffix_order


def brute(rows, units, window, join):
    """(units, removed, spans, digest) of each row; a null id comes after all others."""
    seen, cut = {}, [(10**18 if i is None else i, units(t or "")) for i, t in rows]
    for i, u in cut:
        for p in range(len(u) - window + 1):
            w = u[p : p + window]
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, u in cut:
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if seen[u[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = join(x for x, g in zip(u, gone, strict=True) if not g)
        out.append((len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(t):
    return tuple(t.encode().split())


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 500}, {"chunk_bytes": 40_000, "slice_units": 100}])
def test_substring_dedup(corpus, sizes):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = sorted(zip([i if i is not None else -1 for i, _ in rows], brute(rows, words, 13, b" ".join), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.n_words, r.n_removed, r.n_spans, r.kept_sha256)) for r in substring_dedup(corpus, **sizes).collect())
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_bytes": 5000}, {"chunk_bytes": 200_000, "slice_units": 1000, "heavy": 1e-3}])
def test_suffix_dedup(corpus, sizes):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = sorted(zip([i if i is not None else -1 for i, _ in rows], brute(rows, str.encode, 50, bytes), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup(corpus, **sizes).collect())
    assert got == want


def test_texts_and_spans_are_what_the_digests_say(corpus):
    kept = {r.doc_id: r.kept_text for r in kept_texts(corpus).collect()}
    for r in substring_dedup(corpus).collect():
        if r.doc_id != 3:
            assert hashlib.sha256(kept[r.doc_id].encode()).hexdigest() == r.kept_sha256
    n = {}
    for r in removed_spans(corpus).where("doc_id <> 3").collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.stop - r.start
    assert n == {r.doc_id: r.n_removed for r in suffix_dedup(corpus).where("doc_id <> 3").collect() if r.n_removed}


def test_empty_table(none):
    assert substring_dedup(none).count() == 0
    assert suffix_dedup(none).count() == 0
    assert [c for c, _ in suffix_dedup(none).dtypes] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert all((x + OFFSET[a, b]) % PERIOD in COVER for a in range(PERIOD) for b in range(PERIOD) for x in (a, b))
    with pytest.raises(ValueError, match="window"):
        suffix_dedup(None, window=20)


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 else b for i in range(n)]


def test_texts_whose_polynomial_hashes_agree_are_told_apart(spark):
    """A Thue-Morse text and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    codes = Rolling(12).codes
    both = [Rolling(12).windows(codes[np.frombuffer(x.encode(), np.uint8)], 2048) for x in (one, two)]
    assert (both[0] == both[1]).all()
    docs = spark.createDataFrame([(1, " ".join([one] * 13)), (2, " ".join([two] * 13)), (3, " ".join([one] * 13))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}
    u = _units("byte", np.array([1, 2, 1]), [one.encode(), two.encode(), one.encode()])
    number, first = _apart(u.buf, u.first, u.count, np.array([0]))
    assert number.tolist() == [0, 1, 0] and first.tolist() == [0, 1]
    text = np.frombuffer((one + two + one).encode(), np.uint8)
    order, begin = equal_windows(text, u.first, u.count, u.first, u.count)
    assert sorted(sorted(g.tolist()) for g in np.split(order, begin[1:])) == [[0, 2], [1]]
    rows = [(1, one), (2, two), (3, one[:400] + two[600:])]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(zip([1, 2, 3], brute(rows, str.encode, 50, bytes), strict=True))


PIECES = st.lists(st.one_of(st.binary(min_size=50, max_size=90), st.text(alphabet="ab", min_size=50, max_size=200).map(str.encode), st.integers(50, 300).map(lambda n: b"a" * n)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(PIECES, st.integers(0, 7))
def test_suffix_order_is_that_of_a_plain_sort(pieces, skip):
    pieces = pieces + [p[skip:] for p in pieces if len(p) - skip >= 50]
    text, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    low = np.cumsum(size) - size
    start = np.concatenate([np.arange(a, a + n - 49) for a, n in zip(low, size, strict=True)])
    raw = text.tobytes()
    windows = [raw[start[i] : start[i] + 50] for i in suffix_order(text, low, size, start, 50)[0]]
    assert windows == sorted(windows)
    order, begin = equal_windows(text, low, size, start, 50)
    groups = np.split(order, begin[1:])
    assert len(groups) == len(set(windows)) and all(len({raw[start[i] : start[i] + 50] for i in g}) == 1 for g in groups)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=60).map(str.encode), st.data())
def test_same_bytes(raw, data):
    n = len(raw)
    pairs = [(a, b, data.draw(st.integers(0, n - max(a, b)))) for a, b in data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), min_size=1))]
    a, b, size = (np.array(x) for x in zip(*pairs, strict=True))
    assert same_bytes(np.frombuffer(raw, np.uint8), a, b, size).tolist() == [raw[x : x + k] == raw[y : y + k] for x, y, k in pairs]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 20))
def test_window_hashes_are_a_function_of_the_window(data, k):
    h, other = Rolling(5), Rolling(5)
    buf = np.frombuffer(b"zz" + data, np.uint8)
    a, b = h.windows(h.codes[buf], k), other.windows(other.codes[np.frombuffer(data, np.uint8)], k)
    assert (a[2 : 2 + len(b)] == b).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\x0b\x1c ", max_size=12), max_size=5))
def test_word_spans(texts):
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    start, end, doc = word_spans(buf, np.array([len(r) for r in raw], np.int64))
    got = [[] for _ in raw]
    for a, b, d in zip(start, end, doc, strict=True):
        got[d].append(buf[a:b].tobytes())
    assert got == [r.split() for r in raw]

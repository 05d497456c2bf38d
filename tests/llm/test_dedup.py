"""SimHash and exact dedup, and components, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.exact_dedup import PerfectHash, digest, exact_dedup, keep_first
from plumbline.llm.queries import LLM_ORACLES, LLM_QUERIES
from plumbline.llm.simhash import GOLAY, HAMMING, anchors, fingerprint, keep_representatives, simhash_dedup, simhash_links


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_dedup(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    near = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash_dedup(corpus).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == near[2]  # the text of document 2
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", near[r.doc_id])


def test_fingerprints_of_odd_texts():
    for t in ("", " ", "A", "a b", "A b C", "É é É ß", "x " * 500, "\x1c a b c d"):
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def test_documents_without_words_are_linked_like_others(spark):
    rows = [(5, None, "z"), (9, " \n", "z"), (7, "a b c d e", "z")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(spark.createDataFrame(rows, "doc_id int, text string, component_id string")).collect()}
    assert got[5] == got[9] == ("0" * 16, 5)
    assert got[7][1] == 7


@pytest.mark.parametrize("codes", [(GOLAY, GOLAY), (GOLAY, GOLAY, HAMMING)])
def test_every_near_pair_meets(codes):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = rng.integers(0, 64, (300, 2), dtype=np.uint64)
    y = x ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1])
    _, home, is_home = anchors(x, codes, 0)
    assert len(home) == len(x) and is_home.all()
    at, reached, _ = anchors(y, codes, 2)
    for i in range(len(x)):
        assert home[i] in reached[at == i]


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(30)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    got = {(r.v, r.w) for r in simhash_links(nodes, 2, (GOLAY, GOLAY)).collect()}
    want = {(b, a) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, x) for x in range(501, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    have = set(edges) | {(b, a) for a, b in edges}
    want = groups(nodes, lambda a, b: (a, b) in have)
    shuffled = edges[:]
    rng.shuffle(shuffled)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(shuffled, "v long, w long").repartition(9)).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(spark.createDataFrame([], "v long, w long")).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup(corpus, share):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    same = {}
    for i, t in rows:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for t, ids in same.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup(corpus, share).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_null_ids_alone(spark):
    r = exact_dedup(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [(x.keep_id, x.group_size, x.kept) for x in r] == [(None, 2, True)] * 2


def test_exact_dedup_equals_sql(spark, data):
    from oracle import compare

    assert compare(spark, data, LLM_QUERIES["op5_exact_dedup"], LLM_ORACLES["op5_exact_dedup"]) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    h = PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(n))
    other = np.frombuffer(b"".join(hashlib.sha256(f"-{i}".encode()).digest() for i in range(100)), np.uint8).reshape(-1, 32)
    assert ((h.slots(other) >= -1) & (h.slots(other) < max(n, 1))).all()


def test_digests_are_of_all_bytes(spark):
    """Also of texts that aren't UTF-8: none of their bytes is replaced."""
    raw = [b"  a\t\x0b\n b\xc2\xa0c\x1c d ", b"a\x80 \t b", b"a\x81 \t b", b"", "é  ☃".encode(), b"\xff\xfe\n\n"]
    got = spark.createDataFrame([(bytearray(x),) for x in raw], "b binary").select(F.hex(digest(F.col("b").cast("string"))).alias("d")).collect()
    assert [r.d.lower() for r in got] == [hashlib.sha256(re.sub(rb"[\x20\x09-\x0D]+", b" ", x)).hexdigest() for x in raw]


def test_rows_that_share_an_id(spark):
    rows = [(1, "a  b"), (2, "a b"), (2, "other"), (3, "c"), (3, "c"), (None, "c"), (None, "d"), (None, "d"), (4, None), (5, "")]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, "a  b"), (2, "other"), (3, "c"), (None, "d"), (4, None)], key=repr)


def test_filters_keep_columns(corpus, none):
    for f, gone in ((keep_first, {4, 5, 7, 20, 22, 8} - {8}), (keep_representatives, None)):
        out = f(corpus)
        assert out.columns == corpus.columns
        assert f(none).count() == 0
        if gone:
            assert {0, 4, 5} & {r.doc_id for r in out.collect()} == {0}


def test_empty_tables(none):
    assert simhash_dedup(none).count() == 0
    assert exact_dedup(none).count() == 0

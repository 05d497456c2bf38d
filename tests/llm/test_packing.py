"""Packing against the tokenizer itself, and plain best-fit decreasing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import Windows, WordIds, best_fit, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def checked(df, documents, tokenizer, window):
    """All rows against the tokenizer's own ids; returns the padding."""
    want = Counter()
    ids = {}
    for doc, text in documents:
        x = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, len(x)] += 1
        ids.setdefault((doc, len(x)), []).append(x)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert 1 <= r["length"] <= window
        choices = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in ids[r["doc_id"], r["doc_tokens"]]}
        assert r["ids_crc32"] in choices
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    for key, pieces in by_doc.items():
        covered = Counter(i for a, n in pieces for i in range(a, a + n))
        assert covered == Counter({i: want[key] for i in range(key[1])})
    assert set(by_doc) == set(want)
    return sum(window - sum(n for _, n in p) for p in by_sequence.values())


@pytest.mark.parametrize(("window", "pieces"), [(2048, 4096), (64, 5), (1, 3)])
def test_every_id_once(corpus, tokenizer, window, pieces):
    docs = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    checked(pack_documents(corpus, PATH, window, pieces=pieces), docs, tokenizer, window)


def test_real_documents(spark, tokenizer):
    from plumbline.llm.common import table
    from plumbline.llm.queries import LLM_QUERIES

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    padding = checked(LLM_QUERIES["op12_packing"](spark, d), docs, tokenizer, 2048)
    assert padding < 2048 + 17 * 100


def test_empty(none):
    df = pack_documents(none, PATH)
    assert df.count() == 0 and df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pieces_over_half_a_window(spark, tokenizer):
    docs = [(i, "cat " * 39) for i in range(50)]  # 40 ids each, in windows of 64
    padding = checked(pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 64, slack=2), docs, tokenizer, 64)
    assert padding < 64 + 2 * 50


TEXTS = ["don't stop", "a\x0bb\x0cc\x1cd\x85e f", "é ́x ́", "İstanbul ΣΑΣ ΑΣ", "<|endoftext|> <|startoftext|>x<|endoftext|>", "ﷺ 한국어 각 12,345.67!!", "​ zero​width ﻿", "'s 't 'S it's", "x" * 3000, "  \n "]


def test_words_are_independent(tokenizer):
    """Ids by words are those of the whole text, with a table that starts anew all the time too."""
    rng = random.Random(3)
    alphabet = "abcXYZéÉßǅŸſİıŉΣµÅÅ'’.,!?<|>01  \t\n\x0b\x0c\r\x1c\x85 ́ 中日"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [chr(c) + 'a' + chr(c) + '. A' + chr(c) for c in range(0x21, 0x300)] + ['?!. ;;: ... a.b a..b .a 7. é. é.. x! ”. a”. .. a., don\'t. It\'s! <|endoftext|>. x']
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for cache, size in ((1 << 20, 1 << 19), (50, 64)):
        encode = WordIds(PATH, cache)
        got = [np.concatenate([np.zeros(0, int), *p]).tolist() for p in encode(pa.array(texts), size)]
        assert got == want


def plain_best_fit(lengths, window):
    free = []
    for n in lengths:
        fitting = [f for f in free if f >= n]
        if fitting:
            free[free.index(min(fitting))] -= n
        else:
            free.append(window - n)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(0, 5))
def test_best_fit(lengths, slack):
    lengths = sorted(lengths, reverse=True)
    uncut = best_fit(lengths, 40, 40)
    assert sorted(40 - sum(n for _, _, n in w) for w in uncut) == plain_best_fit(lengths, 40)
    packed = best_fit(lengths, 40, slack)
    cells = Counter((p, i) for w in packed for p, a, n in w for i in range(a, a + n))
    assert cells == Counter((p, i) for p, n in enumerate(lengths) for i in range(n))
    free = [40 - sum(n for _, _, n in w) for w in packed]
    assert min(free, default=0) >= 0 and sum(f > slack for f in free) <= 1


def test_tree():
    w = Windows(10)
    assert w.take(1) is None
    w.put(7, 1), w.put(3, 2), w.put(10, 3), w.put(0, 9)
    assert [w.take(4), w.take(4), w.take(4), w.take(3), w.take(1)] == [(1, 7), (3, 10), None, (2, 3), None]

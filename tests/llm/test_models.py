"""Quality classifier, neighbours, mixing and pieces."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm.mixing import Settings, mix_documents, mix_sources, temperature_weights
from plumbline.llm.permutation_index import closeness, nearest, nearest_pivots
from plumbline.llm.quality import FollowTheLeader, classify_quality, crc_held_out, features, held_out, keep_quality
from plumbline.llm.quality import Settings as QualitySettings
from plumbline.llm.sentencepiece_lattice import decode, decode_documents, encode, encode_documents, load_vocabulary


def test_held_out_rule(spark):
    for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == crc_held_out(r.id)
    assert spark.createDataFrame([(None,)], "id long").select(held_out(F.col("id"))).first()[0] is False


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    r = classify_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((r.score >= 0.7).astype(int) == r.predicted).all()
    assert (r.predicted == r.quality).mean() > 0.95


def test_held_out_labels_and_other_columns_teach_nothing(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = classify_quality(docs, labels).orderBy("doc_id").select("score").collect()
    b = classify_quality(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None), "score": F.lit("clash")}), wrong).orderBy("doc_id").select("score").collect()
    assert a == b


def test_quality_of_odd_rows(spark, corpus, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    r = classify_quality(corpus, labels).collect()
    assert len(r) == corpus.count()
    assert all(0 <= x.score <= 1 for x in r)
    assert len({x.score for x in r if x.doc_id in (6, 7, 8)}) == 1  # the bias alone
    assert classify_quality(none, labels).count() == 0
    assert all(x.score == 0.5 for x in classify_quality(corpus, labels.limit(0)).collect())
    assert keep_quality(corpus, labels).columns == corpus.columns


def test_features_are_the_same_in_any_batch():
    texts = [b"Some words, some WORDS!! and 12 words", b"", b"a a a a", "é ☃".encode()]
    together = features(texts, 12)
    for i, t in enumerate(texts):
        alone = features([t], 12)
        mine = together[0] == i
        assert (together[1][mine] == alone[1]).all()
        assert together[2][mine] == pytest.approx(alone[2])


def plain_scores(train, texts, s):
    """The classifier in plain Python: n-grams of words under the same hash, follow-the-regularised-leader, dot products."""
    from plumbline.llm.hashing import mix
    from plumbline.llm.quality import _WORDS

    def code(word):
        buf = np.frombuffer(word, np.uint8)
        return int(_WORDS.spans(_WORDS.prefix(_WORDS.codes[buf]), np.array([0]), np.array([len(buf)]))[0])

    def mixed(x):
        return int(mix(np.array([x % 2**64], np.uint64))[0])

    def vector(text):
        words, counts = [code(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())], collections.Counter()
        for n in range(s.n_grams):
            for i in range(len(words) - n):
                gram = words[i]
                for w in words[i + 1 : i + n + 1]:
                    gram = mixed(gram * 3 + w)
                counts[mixed(gram + n) % (2**s.bits - 1) + 1] += 1
        length = math.sqrt(sum(counts.values()))
        return {0: 1.0} | {f: math.sqrt(c) / length for f, c in counts.items()}

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    def score(x):
        return 1 / (1 + math.exp(-sum(v * weight(i) for i, v in x.items())))

    for _ in range(s.epochs):
        for text, label in train:
            x = vector(text)
            w, p = {i: weight(i) for i in x}, score(x)
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    return [score(vector(t)) for t in texts]


def test_scores_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["good", "text", "is", "this", "spam!", "buy", "NOW", "é", "1"], int(rng.integers(0, 30)))) for _ in range(120)] + ["", "  "]
    rows = [(i, t, "q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(t.count("spam") < 2), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    s = QualitySettings(bits=12, epochs=2)
    order = [r.id for r in spark.range(len(texts)).orderBy(F.xxhash64(F.lit(1), "id")).collect() if not crc_held_out(r.id)]
    want = plain_scores([(texts[i], int(texts[i].count("spam") < 2)) for i in order], texts, s)
    got = {r.doc_id: r.score for r in classify_quality(docs, labels, settings=s).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)


def test_a_labelled_id_that_many_rows_share(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(1, "x y")] + [(3, "d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, min(("a b c", "x y"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())), (3, "d e")], "doc_id long, text string")
    many = {r.score for r in classify_quality(docs, labels).where("doc_id = 3").collect()}
    assert many == {r.score for r in classify_quality(some, labels).where("doc_id = 3").collect()}


def test_updates_follow_the_definition():
    s = QualitySettings(bits=4, l1=0.1, l2=0.5, alpha=0.5, beta=1.0)
    leader, z, n = FollowTheLeader(s), [0.0] * 16, [0.0] * 16
    rng = np.random.default_rng(1)
    for _ in range(50):
        at, x, y = rng.choice(16, 4, replace=False), rng.random(4), int(rng.integers(2))
        leader.learn(at, x, y)
        w = [0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, v, b in zip(at, x, w, strict=True):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * b
            n[i] += g * g
    assert leader.z == pytest.approx(z)
    assert leader.n == pytest.approx(n)


def exact_nearest(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in (i for i in good if i % every == 0):
        d = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)
        out[q] = d[:k]
    return out


def test_nearest_on_a_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[4][1]) for i in range(300, 340)]  # copies
    odd = [(500, None), (600, [0.0] * 8), (700, [None] + [1.0] * 7), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (1000, [1.0] * 3), (1100, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows + odd + rows[:3]], "vec_id long, embedding array<double>, score double, rank string")
    for block in (8192, 100):
        got = collections.defaultdict(list)
        for r in nearest(df, block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.score, r.vec_id))
        want = exact_nearest(rows, 100, 10)
        assert set(got) == set(want)
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
            assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in nearest(df).collect()] == [(0, 1, 1, pytest.approx(math.sqrt(2)))]
    assert nearest(df.where("vec_id = 0")).count() == 0
    assert nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.1", "check_s"])
def test_recall(spark, data, size):
    if not os.path.exists(f"{data}/../{size}/embeddings.parquet"):
        pytest.skip("no such table here")
    df = spark.read.parquet(f"{data}/../{size}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = exact_nearest(rows, 100, 10), collections.defaultdict(set)
    for r in nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in w}) / len(w) for q, w in want.items()]) >= 0.9


def test_a_vector_that_very_many_rows_share(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 900, 3)] + [(i, rng.normal(size=3).tolist()) for i in range(1000, 1050)]
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((pytest.approx(r.score, abs=1e-12), r.vec_id))
    assert {q: [i for _, i in w] for q, w in got.items()} == {q: [i for _, i in w] for q, w in exact_nearest(rows, 100, 10).items()}
    assert [i for _, i in got[300]] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_footrule():
    rng = np.random.default_rng(2)
    x, pivots, size = rng.normal(size=(50, 5)), rng.normal(size=(12, 5)), 6
    near = nearest_pivots(x, pivots, size)
    place = np.full((50, 12), size)
    np.put_along_axis(place, near, np.arange(size)[None], 1)
    for q in range(5):
        footrule = np.abs(place - place[q]).sum(axis=1)
        assert (size * (size + 1) - 2 * closeness(near, near[q], 12, size) == footrule).all()


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def plain_weights(tokens, flatten=0.5, most=4.0):
    """Weights by source: the exponent on a fine grid, made finer around the best, that meets the entropy and then the repeats."""
    some = {s: n for s, n in tokens.items() if n}
    total = sum(some.values())

    def raised(a):
        z = sum(n**a for n in some.values())
        return {s: n**a / z for s, n in some.items()}

    def search(gap):
        low, high = 0.0, 1.0
        for _ in range(12):
            grid = np.linspace(low, high, 21)
            k = int(np.argmin([abs(gap(a)) for a in grid]))
            low, high = grid[max(0, k - 1)], grid[min(20, k + 1)]
        return (low + high) / 2

    own = entropy(raised(1.0).values())
    target = own + flatten * (math.log(len(some)) - own)
    a = search(lambda x: entropy(raised(x).values()) - target)
    repeats = lambda x: max(w * total / some[s] for s, w in raised(x).items())
    if repeats(a) > most:
        a = max(a, search(lambda x: repeats(x) - most))
    return raised(a)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 10**5), min_size=2, max_size=6), st.floats(0.1, 0.9))
def test_weights_equal_a_plain_search(tokens, flatten):
    if len(set(tokens.values())) > 1:  # of even shares every exponent gives the same weights
        got = temperature_weights(tokens, Settings(flatten=flatten))[1]
        assert got == pytest.approx(plain_weights(tokens, flatten), abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 10**6), min_size=1, max_size=12), st.floats(0, 1), st.floats(1, 10))
def test_temperature_weights(tokens, flatten, most):
    a, w, budget = temperature_weights(tokens, Settings(flatten=flatten, max_repeats=most))
    some = {s: n for s, n in tokens.items() if n}
    if not some:
        assert budget == 0
        return
    assert sum(w.values()) == pytest.approx(1)
    total = sum(some.values())
    shares = [n / total for n in some.values()]
    target = entropy(shares) + flatten * (math.log(len(some)) - entropy(shares))
    repeats = max(w[s] * budget / n for s, n in some.items())
    assert repeats <= most * (1 + 1e-6) or a == 1
    if repeats < most * (1 - 1e-6) and a < 1:
        assert entropy(w.values()) == pytest.approx(target, abs=1e-6)


def test_mix_sources(spark, corpus, none):
    s = Settings(block_docs=2, flatten=1.0)
    rows = mix_sources(corpus, s).collect()
    tokens, source = {}, {}
    for r in corpus.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len((r.text or "").encode().split())
        source[r.doc_id] = r.source
    per = collections.Counter()
    for i, n in tokens.items():
        per[source[i]] += n
    named = {("0" if k is None else f"1{k}"): n for k, n in per.items()}
    _, weight, budget = temperature_weights(named, s)
    for src in per:
        mine = sorted((r for r in rows if r.source == src), key=lambda r: (r.epoch, r.slot))
        allowed = weight["0" if src is None else f"1{src}"] * budget
        used = sum(tokens[r.doc_id] for r in mine)
        assert used <= allowed + 1e-6
        full = int(allowed // per[src])
        for e in range(full):
            assert sorted((r.doc_id for r in mine if r.epoch == e), key=repr) == sorted((i for i in tokens if source[i] == src), key=repr)
        assert all(r.epoch <= full for r in mine)
        # the next document of the last, cut epoch would pass the budget
        assert allowed - used < max(tokens[i] for i in tokens if source[i] == src)
        # a block's documents are together
        for e in range(full + 1):
            seen = [k for k, _ in itertools.groupby(r.block for r in mine if r.epoch == e and r.n_tokens)]
            assert len(seen) == len(set(seen))
    assert mix_sources(none).count() == 0
    again = mix_sources(corpus.repartition(5), s).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    visits = collections.Counter(r.doc_id for r in rows)
    out = mix_documents(corpus, s)
    assert out.columns == corpus.columns
    copies = collections.Counter(r.doc_id for r in out.collect())
    assert copies == {i: n * (2 if i == 3 else 1) for i, n in visits.items()}


@pytest.fixture(scope="session")
def vocabulary():
    return load_vocabulary()


def segmentations(v, ids, data, at=0):
    """All ways to write data, with their weights."""
    if at == len(data):
        yield (), 0.0
        return
    stops = [k for k in range(at + 1, len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80]
    ways = [(k, (ids[data[at:k]],)) for k in stops[:16] if data[at:k] in ids]
    if data[at : stops[0]] not in ids:
        ways.append((stops[0], tuple(int(v.byte_ids[b]) for b in data[at : stops[0]])))
    for k, piece in ways:
        for rest, w in segmentations(v, ids, data, k):
            yield piece + rest, w + sum(v.weight[p] for p in piece)


@pytest.mark.parametrize("text", ["The haus", "  naïve x🚣", "a▁b\n\n", "     ", "é"])
def test_samples_have_their_lattice_share(vocabulary, text):
    v, data, n = vocabulary, text.encode(), 8000
    ids = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}
    share = {s: math.exp(w) for s, w in segmentations(v, ids, data)}
    z = sum(share.values())
    out, count = encode(v, [data] * n, np.arange(n, dtype=np.uint64), 3)
    cut = np.concatenate([[0], np.cumsum(count)])
    got = collections.Counter(tuple(out[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True))
    assert set(got) <= set(share)
    assert sum(abs(got[s] / n - p / z) for s, p in share.items()) / 2 < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4), st.integers(0, 2**64 - 1))
def test_decoding_is_lossless(texts, key):
    v = _VOCABULARY or load_once()
    raw = [t.encode() for t in texts]
    ids, count = encode(v, raw, np.full(len(raw), key, np.uint64), -1)
    cut = np.concatenate([[0], np.cumsum(count)]).astype(int)
    assert [decode(v, ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] == raw


@pytest.mark.parametrize("raw", [b"a\x80b", b"\xff", b"\xc3", b"\xc3(x", b"\xe2\x98", b"ok \xf0\x9f\x9a end", b"\x80\x80 \xbf"])
def test_bytes_that_are_no_text(vocabulary, raw):
    ids, _ = encode(vocabulary, [raw], np.zeros(1, np.uint64), 1)
    assert decode(vocabulary, ids) == raw


def test_rows_that_are_no_text_come_back(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\x80b")), (2, bytearray(b"fine"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    e = encode_documents(df)
    assert all(r.lossless for r in e.collect())
    back = decode_documents(e).select("doc_id", F.col("text").cast("binary").alias("b")).collect()
    assert {r.doc_id: bytes(r.b) for r in back} == {1: b"a\x80b", 2: b"fine"}


def test_units_of_equal_hashes_are_told_apart(vocabulary):
    """A Thue-Morse text and its complement have equal polynomial hashes modulo 2^64."""
    one = bytes(b"ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(bytes.maketrans(b"ab", b"ba"))
    ids, count = encode(vocabulary, [one, two, one], np.zeros(3, np.uint64), 1)
    cut = np.concatenate([[0], np.cumsum(count)])
    assert [decode(vocabulary, ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] == [one, two, one]


_VOCABULARY = None


def load_once():
    global _VOCABULARY
    _VOCABULARY = load_vocabulary()
    return _VOCABULARY


def test_encode_documents(corpus, none):
    e = encode_documents(corpus)
    rows = e.collect()
    assert all(r.lossless and len(r.pieces) == r.n_pieces for r in rows)
    back = {r.doc_id: r.text for r in decode_documents(e).collect()}
    assert back == {r.doc_id: r.text or "" for r in corpus.collect()}
    again = {r.doc_id: r.pieces for r in encode_documents(corpus.repartition(5)).collect()}
    assert again == {r.doc_id: r.pieces for r in rows}
    assert {r.doc_id: r.pieces for r in encode_documents(corpus, seed=43).collect()} != again
    assert encode_documents(none).count() == 0

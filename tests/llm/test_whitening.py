"""Whitening against an eigendecomposition of the whole covariance matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm.whitening import leading_components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "n", 0.5) for i, v in vectors], SCHEMA)


def checked(df, vectors, k=4):
    """All rows against plain numbers; vectors: (id, list of floats) that take part."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    got = sorted(df.collect(), key=lambda r: (r["component"], r["vec_id"], r["whitened"]))
    count = min(k, int((values > 1e-12 * np.trace(cov)).sum()))
    assert len(got) == len(rows) * count
    for c in range(1, count + 1):
        mine = [r for r in got if r["component"] == c]
        want = [(i, float((np.array(x) - sums / n) @ vecs[:, c - 1] / math.sqrt(values[c - 1])), sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in rows]
        by_id = {r["vec_id"]: r["whitened"] for r in mine}
        sign = math.copysign(1, sum(by_id[i] * w for i, w, _ in want))
        want = sorted((i, sign * w, dev) for i, w, dev in want)
        for r, (i, w, dev) in zip(mine, want, strict=True):
            assert r["vec_id"] == i and r["n"] == n and int(r["deviation"]) == dev
            assert r["whitened"] == pytest.approx(w, abs=1e-8, rel=1e-8)
            assert r["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


@pytest.mark.parametrize(("n", "d", "block"), [(400, 64, 24), (300, 40, 6), (50, 3, 24), (9, 20, 5)])
def test_against_eigenvectors(spark, n, d, block):
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, d)) * np.linspace(1, 0.2, d)).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors += [(n + i, x[3].tolist()) for i in range(n)]  # half of all rows are one vector
    checked(whiten(frame(spark, vectors).repartition(5), block=block), vectors)


def test_real_vectors(spark):
    from plumbline.llm.queries import LLM_QUERIES

    d = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    df = LLM_QUERIES["op11_whitening"](spark, d)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    checked(df, vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(30)]
    good += [good[4], (40, [0.0] * 5), (41, [-0.0] * 5), (42, [30.0, -30.0, 0.5, 1.0, 2.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [float("nan")] * 5), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    checked(whiten(frame(spark, good + bad)), good)
    nameless = whiten(frame(spark, good + [(None, good[0][1])]))
    assert nameless.where("vec_id is null").count() == 4


def test_no_variance(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None)])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]  # one direction only
    checked(whiten(frame(spark, flat)), flat)


def test_beyond_long(spark):
    vectors = [(i, [float(i) * 2**20, -float(i)]) for i in range(4000)]
    checked(whiten(frame(spark, vectors)), vectors)
    with pytest.raises(ValueError, match="grid"):
        whiten(frame(spark, [(1, [1e30, 0.0])]))


def test_components_converge():
    """Narrow blocks, close and equal eigenvalues."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.linspace(1, 2, 200) ** 3, np.repeat([3.0, 2.9, 1.0, 0.5], 50), np.r_[np.full(3, 5.0), np.zeros(197)]):
        a = (q * values) @ q.T
        found = leading_components(lambda b, a=a: a @ b, 200, 4, 8, 1e-13, 1e-11, 500)
        assert np.allclose(found.values, np.sort(values)[::-1][:4], rtol=1e-10, atol=1e-12)
        assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-10
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-13)
    with pytest.raises(RuntimeError, match="residual"):
        leading_components(lambda b: a @ b, 200, 4, 4, 1e-30, 1e-30, 3)

"""Digests of sets: what changes them and what doesn't, and how full a node gets."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import heads, merkle, prepare
from plumbline.queries import QUERIES


def plain(rows, leaves=64):
    """The tree of one group, by recursion."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [sha("|".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]
    levels = next(k for k in range(20) if len(rows) <= leaves * 16**k)

    def node(prefix):
        below = sorted({d for d in digests if d.startswith(prefix)})
        if len(prefix) == levels:
            return sha("\n".join(f"{d} {digests.count(d)}" for d in below))
        return sha("\n".join(f"{p} {node(p)}" for p in sorted({d[: len(prefix) + 1] for d in below})))

    return node("")


@pytest.mark.parametrize(("n", "leaves"), [(3, 64), (200, 4), (300, 1)])
def test_against_recursion(spark, n, leaves):
    rng = random.Random(n)
    rows = [(i % 37 if i % 5 else None, rng.choice(["", "a", "ü|1:x", None, str(i)])) for i in range(n)]
    df = spark.createDataFrame(rows, "a long, b string")
    got = [merkle.set_digest(x, [], ["a", "b"], leaves).first() for x in (df, df.orderBy(F.rand(1)), df.repartition(7))]
    assert {(r.rows, r.sha256) for r in got} == {(n, plain(rows, leaves))}
    other = [*rows[1:], (rows[0][0], "changed")]
    assert merkle.set_digest(spark.createDataFrame(other, "a long, b string"), [], ["a", "b"], leaves).first().sha256 != got[0].sha256


def test_values_don_t_run_into_each_other(spark):
    rows = [("a|1:b", "c"), ("a", "b|1:c"), ("", None), (None, ""), ("-", None)]
    digests = spark.createDataFrame(rows, "a string, b string").select(merkle.row_digest("a", "b").alias("d")).collect()
    assert len({r.d for r in digests}) == len(rows)


def test_nodes_stay_small(spark):
    """A hundred times the rows, nodes of about the same size; copies don't fill one."""
    sizes = []
    for n in (640, 64_000):
        d = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("d")).unionAll(spark.range(n).select(F.lit("ab" * 32).alias("d")))
        sizes.append(merkle.largest_node(d, [], "d", merkle.depth(2 * n)))
    assert max(sizes) < 128


def test_identity_of_a_dataset(spark):
    rows = [("a", "q1"), ("b", "q2")]
    df = spark.createDataFrame(rows, "case_id string, query string")
    one = merkle.dataset_identity(df, "case_id", ["query"], 5).first()
    assert one.cases == 2
    assert merkle.dataset_identity(df, "case_id", ["query"], 6).first().sha256 != one.sha256
    for bad in ([("a", "x"), ("a", "y")], [(" ", "x")], [(None, "x")]):
        with pytest.raises(Exception, match="blank or repeated"):
            merkle.dataset_identity(spark.createDataFrame(bad, "case_id string, query string"), "case_id", ["query"], 5).collect()


def test_development_keys_in_stretches(spark):
    """A label with a thousand keys, one with a single key, null keys and labels; the same as one sorted list."""
    rows = [("hot", f"k{i % 1000}") for i in range(3000)] + [("one", "x"), ("two", "x"), ("two", "y"), ("nil", None), ("nil", "z"), (None, "p"), (None, "q")]
    df = spark.createDataFrame(rows, "label string, key string")
    want = set()
    for label in {r[0] for r in rows}:
        keys = sorted({k for la, k in rows if la == label}, key=lambda k: (k is None, hashlib.sha256(f"dev:{k}".encode()).hexdigest()))
        if len(keys) > 1:
            want |= {(label, k) for k in keys[: max(1, len(keys) // 5)]}
    for blocks in (256, 1, 7):
        got = prepare.group_development_digests(df, "label", "key", "dev:", blocks=blocks).collect()
        assert {(r.label, r.key) for r in got} == want


@pytest.mark.parametrize("name", ["split_group20pct", "split_conflicting_keys"])
def test_keys_are_digests(spark, data, name):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, data).explain("formatted")
    dealt = [x for x in out.getvalue().splitlines() if x.startswith("Arguments: hashpartitioning(")]
    assert dealt and not any("key#" in x.split("ENSURE")[0] for x in dealt)


def test_encode_once_by_digest(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    assert sorted((r.t or "", r.vector or []) for r in heads.encode_once(df, "t", lambda t: F.array(F.length(t).cast("double"))).collect()) == [("", []), ("a", [1.0]), ("a", [1.0]), ("b", [1.0])]

"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.fixtures import tidy

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

PROTOS = """protos AS (
    SELECT label AS ord, 'L' || label AS cand, vec_id AS proto_id, embedding::DOUBLE[] AS pv FROM embeddings
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"""
SCORES = (
    PROTOS
    + """, raw AS (
    SELECT e.vec_id, 'L' || e.label AS gold, p.ord, p.cand, least(exp(2.0::DOUBLE), 100) * list_dot_product(e.embedding::DOUBLE[], p.pv) AS score
    FROM embeddings e CROSS JOIN protos p WHERE e.vec_id NOT IN (SELECT proto_id FROM protos)),
topped AS (SELECT *, max(score) OVER (PARTITION BY vec_id) AS m FROM raw),
scores AS (SELECT vec_id, gold, ord, cand, score, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY vec_id) AS prob,
    row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS rank FROM topped),
preds AS (SELECT vec_id, gold, cand AS choice, prob AS confidence FROM scores WHERE rank = 1),
missing AS (SELECT vec_id, gold, CASE WHEN vec_id % 17 <> 0 THEN choice END AS choice FROM preds),
labelset AS (SELECT ord, cand FROM protos)"""
)
CENTROIDS = """, parts AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
centers AS (SELECT label AS ord, 'L' || label AS cand, list(x ORDER BY i) AS cv FROM means GROUP BY label),
cscores AS (SELECT e.vec_id, 'L' || e.label AS gold, c.ord, c.cand, list_dot_product(e.embedding::DOUBLE[], c.cv) AS score
    FROM embeddings e CROSS JOIN centers c WHERE e.vec_id NOT IN (SELECT proto_id FROM protos)),
cpreds AS (SELECT vec_id, gold, cand AS choice FROM cscores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) = 1)"""
MATRIX = """, matrix AS (
    SELECT g.cand AS gold, p.cand AS predicted, count(m.vec_id) AS n
    FROM labelset g CROSS JOIN (SELECT cand FROM labelset UNION ALL SELECT '__failed__') p
    LEFT JOIN missing m ON m.gold = g.cand AND coalesce(m.choice, '__failed__') = p.cand GROUP BY ALL),
classes AS (
    SELECT l.cand AS label,
        (SELECT sum(n) FROM matrix WHERE gold = l.cand)::BIGINT AS support,
        (SELECT sum(n) FROM matrix WHERE predicted = l.cand)::BIGINT AS predicted,
        (SELECT sum(n) FROM matrix WHERE gold = l.cand AND predicted = l.cand)::BIGINT AS tp
    FROM labelset l),
prf AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM classes)"""
WILSON = """
    CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0 ELSE greatest(0, ({k} / {n} + 3.8414588206941254 / (2 * {n})) / (1 + 3.8414588206941254 / {n})
        - 1.959963984540054 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8414588206941254 / (4 * {n} * {n})) / (1 + 3.8414588206941254 / {n})) END"""
WILSON_HIGH = """
    CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1 ELSE least(1, ({k} / {n} + 3.8414588206941254 / (2 * {n})) / (1 + 3.8414588206941254 / {n})
        + 1.959963984540054 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8414588206941254 / (4 * {n} * {n})) / (1 + 3.8414588206941254 / {n})) END"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::DOUBLE", f"({n})::DOUBLE"
    return WILSON.format(k=k, n=n), WILSON_HIGH.format(k=k, n=n)


def mcnemar_sql(f: str, r: str) -> str:
    """Exact two-sided test with logs of factorials."""
    return f"""CASE WHEN {f} = {r} THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({f}, {r})::BIGINT + 1),
        lambda i: exp(lgamma({f} + {r} + 1) - lgamma(i + 1) - lgamma({f} + {r} - i + 1) - ({f} + {r}) * ln(2))))) END"""


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its name; its result is tidied."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__

        def run(spark, d) -> DataFrame:
            return tidy(f(spark, d))

        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return register

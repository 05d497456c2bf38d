"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .mixing import mix_sources
from .oracle_repair import REPAIR
from .packing import pack_documents
from .permutation_index import nearest
from .quality import classify_quality
from .sentencepiece_lattice import encode_documents
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .turn_repair import damaged, repair_turns
from .warc import warc_round_trip
from .whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_turns(damaged(table(spark, sf_dir, "conversations")))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_simhash_dedup, op3_html_extract, op4_quality, op5_exact_dedup, op6_mixing, op7_permutation_index,
        op8_sentencepiece, op9_suffix_dedup, op10_warc, op11_whitening, op12_packing, op13_turn_repair,
    )
}

#: The units that windows cover, by document: maximal runs and the kept rest. Units: doc_id, pos (from 1), unit, of `units`; windows: doc_id, pos, k.
_COVERED = """least AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
        flagged AS (SELECT doc_id, pos FROM windows JOIN least USING (k) WHERE least < doc_id),
        marked AS (SELECT u.doc_id, u.pos, unit, coalesce(max(f.pos) OVER (PARTITION BY u.doc_id ORDER BY u.pos) > u.pos - {window}, false) AS gone
            FROM units u LEFT JOIN flagged f ON f.doc_id = u.doc_id AND f.pos = u.pos),
        runs AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, string_agg(unit, '{joint}' ORDER BY pos) FILTER (NOT gone) AS kept
            FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM marked) GROUP BY doc_id)"""

LLM_ORACLES: dict[str, str] = {
    "op13_turn_repair": REPAIR,
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        units AS (SELECT doc_id, unnest(w) AS unit, generate_subscripts(w, 1) AS pos FROM d),
        lists AS (SELECT doc_id, list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) AS ks FROM d WHERE len(w) >= 13),
        windows AS (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM lists),
        """ + _COVERED.format(window=13, joint=" ") + r"""
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
        FROM d LEFT JOIN runs USING (doc_id)
    """,
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        bytes AS (SELECT doc_id, regexp_extract_all(h, '..') AS b FROM d),
        units AS (SELECT doc_id, unnest(b) AS unit, generate_subscripts(b, 1) AS pos FROM bytes),
        parts AS (SELECT doc_id, h, unnest(range(0, len(h), 2048)) AS first FROM d),
        cut AS (SELECT doc_id, first // 2 AS first, substr(h, first + 1, 2146) AS part FROM parts),
        lists AS (SELECT doc_id, first, list_transform(range(1, least(1024, len(part) // 2 - 49) + 1), lambda i: substr(part, 2 * i - 1, 100)) AS ks FROM cut WHERE len(part) >= 100),
        windows AS (SELECT doc_id, unnest(ks) AS k, first + generate_subscripts(ks, 1) AS pos FROM lists),
        """ + _COVERED.format(window=50, joint="") + r"""
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN runs USING (doc_id)
    """,
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
        g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i::BIGINT * 5 + 1, 5))::BIGINT) AS v FROM p)
        SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
            list_reduce(list_transform(v, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 10) & 31) + 1]
                || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x & 31) + 1]), lambda a, b: a || b) AS payload_digest,
            CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM g
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """
}

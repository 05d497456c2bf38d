"""Suffix-array dedup by difference-cover blockwise construction.

Windows of 50 bytes are dealt into suffix buckets by the least of their grams' hashes, so that equal
windows meet in one bucket. Buckets are sorted one at a time: cover samples (places modulo 21 in the perfect
difference set {3, 6, 7, 12, 14}) are ranked first, suffixes are sorted by their first 24 bytes, and longer
ties are resolved by the ranks (suffix_order.py). Neighbours that share 50 bytes are repeats, and the smallest
document of such a stretch keeps them. Memory is bounded by a chunk or a bucket (repeats.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Plan, Units, remove_repeats
from .suffix_order import PERIOD

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def plan(window: int = 50, gram: int = 16, **more) -> Plan:
    if window < 8 * 3 + PERIOD:
        raise ValueError(f"window must be at least {8 * 3 + PERIOD} bytes")
    return Plan("byte", window, gram, **more)


def _digests(u: Units, ids: list, gone: np.ndarray) -> pa.Table:
    run = np.zeros(len(gone), bool)
    run[u.runs(gone)[0]] = True
    removed, kept = u.by_document(gone), []
    for text, first, n, r in zip(u.texts, u.first.tolist(), u.count.tolist(), removed.tolist(), strict=True):
        kept.append(hashlib.sha256(u.buf[first : first + n][~gone[first : first + n]].tobytes() if r else text).hexdigest())
    return pa.table([pa.array(ids, pa.int64()), u.count.astype(np.int64), removed, u.by_document(run), kept], schema=SCHEMA)


def _spans(u: Units, ids: list, gone: np.ndarray) -> pa.Table:
    a, b = u.runs(gone)
    doc = u.doc(a)
    return pa.table([pa.array([ids[i] for i in doc.tolist()], pa.int64()), a - u.first[doc], b - u.first[doc]], schema=SPANS)


def suffix_dedup(documents: DataFrame, window: int = 50, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document, of its UTF-8 bytes.

    A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller id.
    Null and empty texts: no bytes. Rows with a null id come after all others; rows that share an id don't
    remove from each other. Other columns are ignored; an empty table gives an empty result. Very long texts are whole
    in one chunk: a document is never cut, so it must fit in a task, and being one value it is under 2 GB (a longer one is an error).
    """
    return remove_repeats(documents, plan(window, **more), _digests, SCHEMA)


def removed_spans(documents: DataFrame, window: int = 50, **more) -> DataFrame:
    """doc_id and each maximal removed run as byte offsets."""
    return remove_repeats(documents, plan(window, **more), _spans, SPANS)

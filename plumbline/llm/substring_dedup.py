"""Substring dedup by fixed-block anchors.

Non-overlapping blocks of 7 words are the index; every rolling window of 7 words probes it. A repeat of
13 words holds a whole block of the document it repeats, and all its blocks are in both documents, so
hits lead to all repeats. Around a hit the 13-word windows are held against those of the other documents
that hit the same anchor, byte for byte; the maximal runs of repeated windows are what goes (see repeats.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Plan, Units, remove_repeats

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string())])


def plan(window: int = 13, **more) -> Plan:
    return Plan("word", window, (window + 1) // 2, **more)


def _kept(u: Units, gone: np.ndarray) -> list[bytes]:
    out = []
    for text, first, n in zip(u.texts, u.first, u.count, strict=True):
        words, g = text.split(), gone[first : first + n]
        out.append(b" ".join([words[i] for i in np.flatnonzero(~g)] if g.any() else words))
    return out


def _digests(u: Units, ids: list, gone: np.ndarray) -> pa.Table:
    run = np.zeros(len(gone), bool)
    run[u.runs(gone)[0]] = True
    return pa.table(
        [pa.array(ids, pa.int64()), u.count.astype(np.int64), u.by_document(gone), [hashlib.sha256(k).hexdigest() for k in _kept(u, gone)], u.by_document(run)], schema=SCHEMA
    )


def _texts(u: Units, ids: list, gone: np.ndarray) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array([k.decode() for k in _kept(u, gone)])], schema=KEPT)


def substring_dedup(documents: DataFrame, window: int = 13, **more) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans for every document.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of `window` words that covers it also starts
    in a document with a smaller id. Null and empty texts: no words and the digest of the empty string.
    Rows with a null id come after all others; rows that share an id don't remove from each other. Other
    columns are ignored; an empty table gives an empty result. Very long texts are whole in one chunk: a document is
    never cut, so it must fit in a task, and being one value it is under 2 GB (a longer one is an error).
    """
    return remove_repeats(documents, plan(window, **more), _digests, SCHEMA)


def kept_texts(documents: DataFrame, window: int = 13, **more) -> DataFrame:
    """doc_id and the words that stay, joined by spaces."""
    return remove_repeats(documents, plan(window, **more), _texts, KEPT)

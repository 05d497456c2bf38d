"""Column functions over texts. Built-in where Spark's semantics agree with Unicode's, Arrow UDFs where not."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode words: letters, numbers and the underscore (a plain \w is ASCII-only here).
TOKEN = r"[\p{L}\p{N}_]+"
_WHITE = r"(?U)[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(x, f"{_WHITE.replace('(?U)', '(?U)^')}+|{_WHITE.replace('(?U)', '')}+$", "")


def is_blank(x: Column) -> Column:
    return x.rlike(r"(?U)^[\s\x1c-\x1f]*$")


def collapse(x: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), f"{_WHITE}+", " "))


def tokens(x: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))


def label_text(x: Column) -> Column:
    """A label as words: underscores as spaces, in lower case."""
    return F.lower(F.replace(x, F.lit("_"), F.lit(" ")))


def token_set(x: Column, pattern: str = TOKEN) -> Column:
    return F.array_distinct(tokens(x, pattern))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct tokens two token arrays share."""
    return F.size(F.array_intersect(a, b))


@F.pandas_udf(StringType())
def casefold_collapse(x: pd.Series) -> pd.Series:
    """Full case folding, which lower() is not (one letter in four hundred German texts is enough)."""
    return x.map(lambda s: None if s is None else " ".join(s.casefold().split()))


@F.pandas_udf(StringType())
def compatible_collapse(x: pd.Series) -> pd.Series:
    """NFKC, case folding and collapsed white space."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def canonical_json(value: object) -> str:
    """Compact JSON in insertion order, non-ASCII kept, numbers as Python prints them, no NaN."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(StringType())
def canonical_digest(x: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text's canonical form; duplicate keys are an error."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate JSON key")
        return dict(pairs)

    def one(s: str | None) -> str | None:
        return None if s is None else hashlib.sha256(canonical_json(json.loads(s, object_pairs_hook=unique)).encode()).hexdigest()

    return x.map(one)


def selection_key(prefix: str, *parts: Column) -> Column:
    """SHA-256 of the prefixed parts: an order that depends on nothing but the row."""
    return F.sha2(F.concat(F.lit(prefix), *[p.cast("string") for p in parts]), 256)


def csv_safe(x: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(x.rlike(r"^[=+@\t\r\n-]"), F.concat(F.lit("'"), x)).otherwise(x)


def shorten(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x)


def markdown_cell(x: Column, most: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(x, f"{_WHITE}+", " "))
    return shorten(F.regexp_replace(flat, r"([\\|`*_<>\[\]])", r"\\$1"), most)


def request_id(x: Column) -> Column:
    """A bounded printable id, or null."""
    return F.when(x.rlike(r"^[A-Za-z0-9._-]{1,128}$"), x)

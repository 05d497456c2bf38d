"""The catalogue: a Spark query for each operator, and SQL that says the same."""

from __future__ import annotations

from . import decisions, evaluation, events, records, runs, texts  # noqa: F401
from .registry import ORACLES, QUERIES

ENTRY = "classification_summary"

__all__ = ["ENTRY", "ORACLES", "QUERIES"]

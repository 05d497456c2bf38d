"""Counterfactual replay of recorded traces: one boundary is changed, and what lies downstream of it is computed again.

A rule says which columns a column comes from and how. What doesn't depend on the change is kept as it was recorded; what depends on it
and has no rule is unknown, never the old value. Replays are diagnostic: they bear the original's digest and are never counted among eligible attempts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merkle import row_digest


@dataclass(frozen=True)
class Rule:
    """column is made from `inputs` by make(); None where it depends on them and can't be made again."""

    column: str
    inputs: tuple[str, ...]
    make: Callable[[], Column] | None = None


def downstream(boundary: str, rules: list[Rule]) -> list[Rule]:
    """The rules that a change of a column reaches, each behind those that it needs; a circle is an error."""
    reached, left = {boundary}, [r for r in rules if r.column != boundary]
    while more := {r.column for r in left if reached & set(r.inputs)} - reached:
        reached |= more
    todo, out, made = [r for r in left if r.column in reached], [], {boundary}
    while todo:
        ready = [r for r in todo if not (set(r.inputs) & (reached - made))]
        if not ready:
            raise ValueError(f"rules depend on each other: {sorted(r.column for r in todo)}")
        out, made = out + ready, made | {r.column for r in ready}
        todo = [r for r in todo if r not in ready]
    return out


def trace_digest(traces: DataFrame, columns: list[str]) -> Column:
    return row_digest(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in columns])


def replay(traces: DataFrame, boundary: str, change: Column, rules: list[Rule], recorded: list[str], purpose: str) -> DataFrame:
    """The traces with `boundary` changed and everything downstream computed again: the same columns, and replay_, a struct.

    recorded: the columns that a trace's digest is over. replay_ has original_trace_sha256, changed_boundary, purpose, and
    recomputed and unknown, the columns that were made again and those that can't be. `replay`, where the traces have it, becomes true.
    """
    if boundary not in traces.columns:
        raise ValueError(f"{boundary} isn't recorded")
    kinds = dict(traces.dtypes)
    reached = [r for r in downstream(boundary, rules) if r.column in traces.columns]
    out = traces.withColumn("original_", trace_digest(traces, recorded)).withColumn(boundary, change)
    lost: set[str] = set()
    for r in reached:
        if r.make is None or lost & set(r.inputs):
            lost.add(r.column)
        out = out.withColumn(r.column, F.lit(None).cast(kinds[r.column]) if r.column in lost else r.make())
    names = lambda some: F.array(*[F.lit(c) for c in some]).cast("array<string>")
    about = F.struct(
        F.col("original_").alias("original_trace_sha256"), F.lit(boundary).alias("changed_boundary"), F.lit(purpose).alias("purpose"),
        names([r.column for r in reached if r.column not in lost]).alias("recomputed"), names(sorted(lost)).alias("unknown"),
    )
    out = out.withColumn("replay_", about).drop("original_")
    return out.withColumn("replay", F.lit(True)) if "replay" in traces.columns else out


def effects(traces: DataFrame, replays: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, bound (the replay is of this very trace), changed: the columns that a replay has other values in. Unknown ones aren't changed."""
    own = traces.select(*keys, trace_digest(traces, columns).alias("own_"), *[F.col(c).alias(f"{c}_before_") for c in columns])
    both = replays.join(own, keys)
    differs = lambda c: F.to_json(F.struct(F.col(c).alias("v"))) != F.to_json(F.struct(F.col(f"{c}_before_").alias("v")))
    known = lambda c: ~F.array_contains("replay_.unknown", c)
    changed = F.filter(F.array(*[F.when(known(c) & differs(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select(*keys, (F.col("replay_.original_trace_sha256") == F.col("own_")).alias("bound"), changed.alias("changed"))

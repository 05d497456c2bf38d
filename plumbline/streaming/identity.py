"""Recorded attempts as a stream with state by example: the first model, the repeats that are done, and the failures.

An answer of another model than the example's first is a failure, as in a batch run. A repeat that was seen before, in this run of the query or
one before a restart, is skipped, so attempts that a source delivers again change nothing. State is small: a model's name and a number for each example, and a bit for
each attempt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

IN = ["example", "repeat", "model", "choice", "error_type"]
OUT = "example string, repeat bigint, model string, choice string, error_type string, failures bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The store that keyed state needs; a micro-batch uploads its changes only, not whole files of the store.
CONF = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Examples whose ids agree but for so many last bits share a key, and so many repeats of theirs an entry of its map: a call for state is a round
#: trip to the JVM of about a tenth of a millisecond, and a key's table costs milliseconds however few its rows.
BUNDLE_BITS, BLOCK = 5, 1024
#: Rows of a table that a key gives out, or some more.
CHUNK = 10_000


class _Identity(StatefulProcessor):
    """One bundle's first models and failures by example, and its repeats that were seen: a bit each, by block of repeats and example."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "examples array<string>, models array<string>, failures array<bigint>")
        self.seen = handle.getMapState("seen", "block bigint", "examples array<string>, bits array<binary>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {e: (m, n) for e, m, n in zip(*(self.known.get() or ((), (), ())), strict=True)}
        batch = pd.concat(list(rows), ignore_index=True).sort_values("repeat", kind="stable")  # one bundle's rows of one micro-batch
        batch["repeat"] = batch["repeat"].astype("int64")
        out, any_new = [], False
        for block, some in batch.groupby(batch["repeat"] // BLOCK):
            found = self.seen.getValue((int(block),)) or ((), ())
            seen = {e: int.from_bytes(b, "little") for e, b in zip(*found, strict=True)}
            before = len(out)
            for example, repeat, model, choice, error in zip(*(some[c].tolist() for c in IN), strict=True):
                bits, bit = seen.get(example, 0), 1 << repeat % BLOCK
                if bits & bit:
                    continue
                seen[example] = bits | bit
                first, failures = known.get(example, (None, 0))
                if first is None and choice is not None:
                    first = model
                if choice is not None and model != first:
                    choice, error = None, "ModelChanged"
                failures += choice is None
                known[example] = first, failures
                out.append((example, repeat, model, choice, error, failures))
            if len(out) > before:
                any_new = True
                self.seen.updateValue((int(block),), (list(seen), [b.to_bytes(BLOCK // 8, "little").rstrip(b"\0") for b in seen.values()]))
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=[*IN, "failures"])
                out = []
        if any_new:
            self.known.update((list(known), [m for m, _ in known.values()], [n for _, n in known.values()]))
        if out:
            yield pd.DataFrame(out, columns=[*IN, "failures"])

    def close(self) -> None:
        pass


def checked_attempts(attempts: DataFrame) -> DataFrame:
    """example, repeat, model, choice, error_type, failures (so far) of a stream of example, repeat, model, choice, error_type.

    The session's state store must be RocksDB (PROVIDER). Within a micro-batch attempts count by repeat.
    """
    bundle = F.coalesce(F.shiftright("example", BUNDLE_BITS), F.lit(0)).alias("bundle")
    rows = attempts.select(bundle, F.col("example").cast("string").alias("example"), *IN[1:])  # as text an id may be null
    checked = rows.groupBy("bundle").transformWithStateInPandas(_Identity(), OUT, "append", "none")
    return checked.withColumn("example", F.col("example").cast("bigint"))


def run_checked(attempts: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """All that the source has by now, appended to `output` once; started again, the query goes on where it ended."""
    for name, value in CONF.items():
        attempts.sparkSession.conf.set(name, value)
    return checked_attempts(attempts).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)

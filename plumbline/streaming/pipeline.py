"""Record pipelines as structured streams: score each record once, keep errors as data, resume from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT = "choice string, error_type string"


def guarded(scorer: Callable[[str], str], text: str, keep: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapInPandas function around a scorer: a failure becomes the name of its class, never its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[text]:
                try:
                    rows.append((scorer(value), None))
                except Exception as e:  # noqa: BLE001  the error is data
                    rows.append((None, type(e).__name__[:128]))
            yield pd.DataFrame({keep: batch[keep], "choice": [r[0] for r in rows], "error_type": [r[1] for r in rows]})

    return run


def evaluate(df: DataFrame, scorer: Callable[[str], str], text: str, keep: str, workers: int | None = None) -> DataFrame:
    """Batch evaluation with errors captured; workers bounds how many tasks call the scorer at once."""
    kind = dict(df.dtypes)[keep]
    dealt = df if workers is None else df.repartition(workers)
    return dealt.select(keep, text).mapInPandas(guarded(scorer, text, keep), f"{keep} {kind}, {RESULT}")


def evaluate_repeats(df: DataFrame, scorer: Callable[[str], str], text: str, keep: str, repeats: int, warmups: int = 0, workers: int | None = None) -> DataFrame:
    """keep, phase (warmup, sample), repeat, choice, error_type: every example warm-ups and repeats times, errors as data."""
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(i).alias("repeat")) for p, n in (("warmup", warmups), ("sample", repeats)) for i in range(n)])
    rows = df.select(keep, text, F.inline(phases)).withColumn("key_", F.struct(keep, "phase", "repeat"))
    named = rows.withColumn("key_", F.to_json("key_"))
    done = evaluate(named, scorer, text, "key_", workers)
    kind = dict(df.dtypes)[keep]
    return done.select(F.from_json("key_", f"{keep} {kind}, phase string, repeat int").alias("k"), "choice", "error_type").select("k.*", "choice", "error_type")


def evaluate_rag(cases: DataFrame, pipeline: Callable[[str], dict], review: Callable[[str, dict], dict] | None, repeats: int, workers: int | None = None) -> DataFrame:
    """case_id, repeat, context, answer, review_correct, error_phase, error_type: one row for every planned attempt.

    pipeline(query) gives context (texts) and answer; review(query, output) gives correct. A failure is
    kept by phase and the name of its class. At most `workers` attempts run at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for case, repeat, query in zip(batch["case_id"], batch["repeat"], batch["query"], strict=True):
                out, verdict, phase, kind = {}, {}, "pipeline", None
                try:
                    out = pipeline(query)
                    phase = "review"
                    verdict = review(query, out) if review else {}
                    phase = None
                except Exception as e:  # noqa: BLE001  the error is data
                    kind = type(e).__name__[:128]
                rows.append((case, repeat, out.get("context"), out.get("answer"), verdict.get("correct"), phase, kind))
            yield pd.DataFrame(rows, columns=["case_id", "repeat", "context", "answer", "review_correct", "error_phase", "error_type"])

    planned = cases.select("case_id", "query", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    dealt = planned if workers is None else planned.repartition(workers)
    return dealt.mapInPandas(run, "case_id string, repeat int, context array<string>, answer string, review_correct boolean, error_phase string, error_type string")


def stream_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def classify_stream(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is judged and appended once: a batch that is replayed after a failure replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        judge(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, late: str, window: str, *by: str) -> DataFrame:
    """Counts and totals by event-time window, for batch and stream alike; `late` bounds the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

"""python -m plumbline list | run NAME DATA [--out PATH] | report FOLDER DATA NAME... | rag FOLDER CASES ATTEMPTS | verify RUN"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import experiment
from .queries import ORACLES, QUERIES
from .report import markdown, rows_of, write_bundle
from .sources.receipts import load_run, receipts
from .workers import find_package


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("plumbline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="queries, and whether they have SQL")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("data")
    run.add_argument("--out", help="a Parquet folder that doesn't exist; without it the first rows are shown")
    report = sub.add_parser("report", help="write small results as JSON, Markdown and CSV")
    report.add_argument("folder")
    report.add_argument("data")
    report.add_argument("names", nargs="+", choices=sorted(QUERIES))
    rag = sub.add_parser("rag", help="assess recorded retrieval attempts; the status is 1 unless they are complete and pass their gates")
    rag.add_argument("folder", help="where the report goes; it mustn't exist")
    rag.add_argument("cases", help="a Parquet folder of cases")
    rag.add_argument("attempts", help="a Parquet folder of attempts")
    rag.add_argument("--gates", help="a JSON list of metric, minimum, maximum, min_coverage")
    rag.add_argument("-k", type=int, default=5)
    rag.add_argument("--repeats", type=int, default=1)
    verify = sub.add_parser("verify", help="read a saved run against its receipts; the status is 1 if a byte has changed")
    verify.add_argument("run")
    got = top.parse_args(args)
    if got.command == "list":
        print("\n".join(f"{n}{'' if n in ORACLES else '  (no SQL)'}" for n in sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    find_package(spark)
    if got.command == "rag":
        return _rag(spark, got)
    if got.command == "verify":
        return _verify(spark, got.run)
    if got.command == "report":
        write_bundle(got.folder, {n: QUERIES[n](spark, got.data) for n in got.names})
    elif got.out:
        QUERIES[got.name](spark, got.data).write.mode("errorifexists").parquet(got.out)
    else:
        print(markdown(got.name, rows_of(QUERIES[got.name](spark, got.data).limit(20))))
    return 0


GATES = "metric string, minimum double, maximum double, min_coverage double"


def _rag(spark: SparkSession, got: argparse.Namespace) -> int:
    """Writes the report of an experiment: summary, gates, state, verdict."""
    rules = json.loads(Path(got.gates).read_text(encoding="utf-8")) if got.gates else []
    gates = spark.createDataFrame([(r["metric"], *(None if r.get(n) is None else float(r[n]) for n in ("minimum", "maximum")), float(r.get("min_coverage", 0))) for r in rules], GATES)
    cases, attempts = (spark.read.parquet(p) for p in (got.cases, got.attempts))
    found = experiment.report(cases, attempts, gates, got.k, got.repeats)
    write_bundle(got.folder, {n: found[n] for n in ("summary", "gates", "state", "verdict")})
    verdict = json.loads((Path(got.folder) / "report.json").read_text(encoding="utf-8"))["verdict"][0]
    print(markdown("verdict", [verdict]))
    return 0 if verdict["status"] == "complete" and verdict["passed"] is not False else 1


def _verify(spark: SparkSession, run: str) -> int:
    """Every part is read by a task of its own."""
    try:
        found = receipts(spark, run)
        rows = load_run(spark, run, "_ string").count()
    except Exception as e:  # noqa: BLE001  a run that can't be read isn't right either
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    print(markdown(f"{rows} rows", rows_of(found)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

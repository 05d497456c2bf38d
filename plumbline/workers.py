"""Lets Python workers find this package when it isn't installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def find_package(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path; on a cluster where it is installed this changes nothing."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])

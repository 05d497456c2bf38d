"""What the corpus operators share: reading tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def bounded(df: DataFrame, batch: str = "8m") -> DataFrame:
    """The same rows, sent to Python in batches of bounded bytes, however long their texts are.

    The session's own limit stays if it is smaller.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number = re.fullmatch(r"(\d+)([bkm]?)b?", conf.get(name, "64m").lower())
    size = int(number[1]) * {"k": 1 << 10, "m": 1 << 20}.get(number[2], 1) if number else math.inf
    if size > int(batch[:-1]) << 20:
        conf.set(name, batch)
    return df


class Written:
    """A DataFrame written as Parquet in the shared folder: later reads survive lost executors.

    The files go when the application ends, or before that with drop().
    """

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/plumbline/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.options(compression="zstd", **options).parquet(self.path)
        files, path = self._files()
        files.deleteOnExit(path)

    def _files(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only when nothing that is still to run reads them."""
        files, path = self._files()
        files.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs whose plans nobody holds any longer.

    The cleaner follows the driver's garbage collector, which a small driver heap seldom triggers.
    """
    for _ in range(2):  # the first lets go of the plans, the second finds their shuffles unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def chunk_of(key: Column, total: int, chunk_bytes: int) -> Column:
    """A chunk number from a key's hash: about chunk_bytes of text in each, at any total."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(total / chunk_bytes)))).cast("int")

"""Strict sources and sinks: pinned schemas, rejected duplicates, no overwritten output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import csv_safe


class SourceError(ValueError):
    """A source that breaks its contract; messages name places, not values."""


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole JSON files, one record each: `record`, and `valid`, false for malformed ones and repeated keys.

    The variant parser sees repeated keys, which from_json would silently merge.
    """
    raw = spark.read.text(path, wholetext=True)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return raw.select(F.col("_metadata.file_path").alias("file"), validated_json(F.col("value")).alias("valid"), F.from_json("value", ddl).alias("record"))


def validated_json(raw):
    return F.try_parse_json(raw).isNotNull()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files of any size: no file is read as one value.

    A split's lines are numbered where they are read, and start from the lines of the file's splits before it, which are counted
    first. The table of splits is a row for each 128 MB or so.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    per = read.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "split", (before - F.col("first") + 1).alias("offset"))
    # ids follow one another within a split, in both readings of the same files
    return read.join(F.broadcast(per), ["file", "split"]).select("file", (F.col("id") + F.col("offset")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, numbered: bool = False) -> DataFrame:
    """Records of JSONL files; a malformed line, a repeated key or a wrong type fails the read. Blank lines are skipped.

    numbered: errors name the line, and `line` is a column, for files of any size.
    """
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    place = F.concat(F.col("file"), F.lit(" line "), F.col("line").cast("string")) if numbered else F.col("file")
    lines = lines.where(F.trim("value") != "")
    checked = F.when(validated_json(F.col("value")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed JSON or repeated key in "), place)))
    record = F.from_json(checked, ddl, {"mode": "FAILFAST"}).alias("r")
    return lines.select("line", record).select("line", "r.*") if numbered else lines.select(record).select("r.*")


def labelled_cases(spark: SparkSession, path: str, schema: StructType | str, split: str) -> DataFrame:
    """The cases of one split of a JSONL file; ids must be there and unique among them, or the read fails."""
    rows = json_lines(spark, path, schema).where(F.col("split") == split)
    bad = rows.groupBy("id").count().where("id is null or count > 1")
    if not bad.isEmpty():
        raise SourceError(f"{path}: missing or repeated ids in split {split}")
    return rows


def case_datasets(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choice and ranking cases of a dataset of both (`kind`); any other kind fails the query."""
    known = F.when(F.col("kind").isin("choice", "ranking"), F.col("kind")).otherwise(F.raise_error(F.lit("a case is of kind choice or ranking")))
    checked = cases.withColumn("kind", known)
    return tuple(checked.where(F.col("kind") == k).drop("kind") for k in ("choice", "ranking"))


def strict_csv(spark: SparkSession, path: str, schema: StructType | str, rows: int | None = None) -> DataFrame:
    """CSV with a pinned header and column count, multi-line cells allowed; optionally a pinned row count."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, multiLine=True, escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    if rows is not None and (n := df.count()) != rows:
        raise SourceError(f"{path}: {n} rows, not {rows}")
    return df


def csv_with_notes(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a byte order mark, and perhaps a last column without a name, which is dropped."""
    first = spark.read.text(path).first()
    names = [] if first is None else first[0].lstrip("\ufeff").rstrip("\r").split(",")
    named = spark.createDataFrame([], schema).schema
    if [n.strip('"') for n in names[: len(named)]] != named.names or len(names) > len(named) + 1 or any(n.strip('"') for n in names[len(named) :]):
        raise SourceError(f"{path}: other columns than {named.names}")
    read = StructType([*named.fields, *([StructField("notes_", StringType())] if len(names) > len(named) else [])])
    df = spark.read.csv(path, schema=read, header=True, multiLine=True, escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    return df.select(*named.names)


def split_csv(spark: SparkSession, path: str, schema: StructType | str, split: str, rows: int | None = None) -> DataFrame:
    """A strict CSV file's rows with `id` as split:number, in file order: one file, read whole, so it must be small."""
    df = strict_csv(spark, path, schema, rows)
    return df.select(F.concat(F.lit(f"{split}:"), (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("string")).alias("id"), F.lit(split).alias("split"), "*")


def source_prefix(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in source order; fewer than n are an error."""
    if (have := df.count()) < n:
        raise SourceError(f"{n} rows are asked for, {have} are there")
    return df.orderBy(order).limit(n)


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One digest of a set of files, by path order."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree_sha256"))


def new_json(df: DataFrame, path: str) -> None:
    """JSONL to a place that must not exist."""
    df.write.mode("errorifexists").json(path)


def new_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def new_csv(df: DataFrame, path: str) -> None:
    """CSV to a place that must not exist, text cells safe for spreadsheets."""
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    # rebalanced, so that no part holds the header only
    df.select(*safe).hint("rebalance").write.mode("errorifexists").csv(path, header=True)


def partial_lines(df: DataFrame, path: str) -> DataFrame:
    """What a failed run has completed: rows are appended as they come, and read back here."""
    return df.sparkSession.read.schema(df.schema).json(path)


def history(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """A row for every report.json below root."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").option("multiLine", True).schema(schema).json(root)
    return found.select(F.col("_metadata.file_path").alias("file"), "*")


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A one-to-one left join: a repeated key on the right fails the query."""
    one = right.groupBy(*keys).agg(F.count("*").alias("n_"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    single = F.when(F.col("n_") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"repeated {keys}")).cast("boolean"))
    return left.join(one.where(single).drop("n_"), keys, "left")


def schema_json(df: DataFrame) -> str:
    return df.schema.json()

"""Runs saved as JSON lines with receipts, by a data source of our own, and read back only if every byte is as it was.

Each task writes one part and, when it is whole, a receipt beside it: rows, bytes, SHA-256. A finished run has a manifest, put in place
by one rename, that lists the receipts and a digest over them. A run that was interrupted has no manifest; what can be used of it are the parts from
the first one on whose receipts are there. A part that isn't as its receipt says is refused before any of its rows is read. A run
is never written over. The folder must be one that driver and executors mount (a file: path).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import canonical_json

NAME, MANIFEST = "plumbline_run", "manifest.json"


class RunError(ValueError):
    """A saved run that isn't as its receipts say."""


@dataclass
class Receipt(WriterCommitMessage):
    part: int
    file: str
    rows: int
    bytes: int
    sha256: str


def _local(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: runs are saved in a mounted folder")
    return Path(path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path)


def _put(path: Path, value: dict) -> None:
    """Written beside its place and moved there at once; an existing file is an error."""
    beside = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
    beside.write_text(canonical_json(value) + "\n", encoding="utf-8")
    try:
        os.link(beside, path)  # fails where a file is, which a rename wouldn't
    finally:
        beside.unlink()


def chain(receipts: list[Receipt]) -> str:
    """One digest over the parts in order."""
    digest = hashlib.sha256()
    for r in receipts:
        digest.update(f"{r.part} {r.rows} {r.bytes} {r.sha256}\n".encode())
    return digest.hexdigest()


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipt:
        part, folder = TaskContext.get().partitionId(), Path(self.folder)
        file = f"part-{part:05d}-{uuid.uuid4().hex}.jsonl"  # an attempt of its own: one that dies leaves no receipt
        digest, rows, size = hashlib.sha256(), 0, 0
        with open(folder / file, "xb") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    line = canonical_json(row).encode() + b"\n"
                    out.write(line)
                    digest.update(line)
                    rows, size = rows + 1, size + len(line)
            out.flush()
            os.fsync(out.fileno())
        receipt = Receipt(part, file, rows, size, digest.hexdigest())
        try:
            _put(folder / f"part-{part:05d}.receipt.json", asdict(receipt))
        except FileExistsError:  # another attempt of this part was whole first
            (folder / file).unlink()
            receipt = _receipt(folder / f"part-{part:05d}.receipt.json")
        return receipt

    def commit(self, messages: list[Receipt]) -> None:
        receipts = sorted((m for m in messages if m is not None), key=lambda r: r.part)
        _put(Path(self.folder) / MANIFEST, {"parts": [asdict(r) for r in receipts], "rows": sum(r.rows for r in receipts), "bytes": sum(r.bytes for r in receipts), "sha256": chain(receipts)})

    def abort(self, messages: list[Receipt]) -> None:
        """What is whole stays, with its receipts, for `usable`."""


def _receipt(path: Path) -> Receipt:
    return Receipt(**json.loads(path.read_text(encoding="utf-8")))


def receipts_of(folder: Path, unfinished: bool = False) -> list[Receipt]:
    """A run's receipts, by its manifest; of an unfinished one, those of the parts from the first on without a gap."""
    manifest = folder / MANIFEST
    if manifest.exists():
        said = json.loads(manifest.read_text(encoding="utf-8"))
        receipts = [Receipt(**r) for r in said["parts"]]
        if said["sha256"] != chain(receipts) or said["rows"] != sum(r.rows for r in receipts) or said["bytes"] != sum(r.bytes for r in receipts):
            raise RunError(f"{manifest} doesn't agree with its parts")
        if [r.part for r in receipts] != list(range(len(receipts))):
            raise RunError(f"{manifest} lacks a part")
        return receipts
    if not unfinished:
        raise RunError(f"{folder} has no manifest: the run isn't finished")
    out = []
    while (path := folder / f"part-{len(out):05d}.receipt.json").exists():
        out.append(_receipt(path))
    return out


@dataclass
class _Part(InputPartition):
    receipt: Receipt


def checked_lines(folder: Path, receipt: Receipt) -> Iterator[bytes]:
    """A part's lines, once all its bytes are known to be right; a piece of the file at a time."""
    path = folder / Path(receipt.file).name
    digest, size, rows, end = hashlib.sha256(), 0, 0, b"\n"
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
            size, rows, end = size + len(piece), rows + piece.count(b"\n"), piece[-1:]
        if (size, rows, digest.hexdigest()) != (receipt.bytes, receipt.rows, receipt.sha256) or end != b"\n":
            raise RunError(f"{path} isn't as its receipt says")
        f.seek(0)
        yield from f


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, unfinished: bool):
        self.folder, self.schema, self.unfinished = folder, schema, unfinished

    def partitions(self) -> list[_Part]:
        return [_Part(r) for r in receipts_of(Path(self.folder), self.unfinished)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # a run without parts
            return
        schema, held, size = to_arrow_schema(self.schema), [], 0
        for line in checked_lines(Path(self.folder), partition.receipt):
            held.append(json.loads(line))
            size += len(line)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the saved rows")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        folder = _local(self.options["path"])
        if overwrite:
            raise ValueError("a saved run is never written over")
        folder.mkdir(parents=True, exist_ok=True)
        if any(folder.iterdir()):
            raise FileExistsError(f"{folder} isn't empty")
        return _Writer(str(folder))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(str(_local(self.options["path"])), schema, self.options.get("unfinished", "false") == "true")


def save_run(rows: DataFrame, path: str) -> None:
    """Rows (strings, whole numbers, doubles, booleans, arrays and structs of these) to an empty or new folder, a part for each partition, in its order."""
    rows.sparkSession.dataSource.register(RunSource)
    rows.write.format(NAME).mode("append").save(path)


def load_run(spark: SparkSession, path: str, schema: StructType | str, unfinished: bool = False) -> DataFrame:
    """A saved run's rows. Changed, cut or lost bytes fail the query that reads them. unfinished: the whole parts of an interrupted run will do."""
    spark.dataSource.register(RunSource)
    return spark.read.format(NAME).schema(schema).option("unfinished", str(unfinished).lower()).load(path)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, bytes, sha256 of a finished run: a row a part."""
    found = [(r.part, r.rows, r.bytes, r.sha256) for r in receipts_of(_local(path))]
    return spark.createDataFrame(found, "part int, rows bigint, bytes bigint, sha256 string")


REPORT = "report.json"


def save_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A run, and beside it its summary (one row of numbers), bound to the run's bytes."""
    save_run(rows, path)
    values = summary.first().asDict()
    _put(_local(path) / REPORT, {"run_sha256": chain(receipts_of(_local(path))), "summary": {k: None if v is None else float(v) for k, v in values.items()}})


def load_report(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """A saved run's rows and its recorded summary, refused if they don't belong together; recompute one from the other with runs.verify."""
    said = json.loads((_local(path) / REPORT).read_text(encoding="utf-8"))
    if said["run_sha256"] != chain(receipts_of(_local(path))):
        raise RunError(f"{path}: the report is of another run")
    names = list(said["summary"])
    recorded = spark.createDataFrame([tuple(said["summary"][n] for n in names)], ", ".join(f"`{n}` double" for n in names))
    return load_run(spark, path, schema), recorded

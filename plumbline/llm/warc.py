"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader goes through an archive once: it inflates a member at a time in small pieces (incremental
zlib), frames the block by the record's Content-Length, and checks the digests that the record states.
It takes any record type and any order or case of headers, so archives of other writers too. Records of
equal payloads are written once as a response and then as revisits (profile identical-payload-digest),
whose block has the HTTP header only; its Content-Length says how long the payload was. Payloads are
equal if their length and SHA-256 are; SHA-1 is only the label that the format asks for.

Archives are rows of bytes in a Parquet table in the shared folder, as Spark writes no raw files; each is
a whole .warc.gz file, and export_archives writes them as such.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded, free_shuffles

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_SPACE = uuid.UUID("5f1c1ce5-2f2d-4a3e-8f3a-6a0f0f3d9b11")
_DATE = "2024-01-01T00:00:00Z"
#: So many revisits may be sent to all executors (about 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class WarcError(ValueError):
    """An archive that isn't framed as it says, or whose digests don't hold."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


class Headers(dict):
    """Header fields by lower-case name; the first of a name counts."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())


@dataclass
class Record:
    headers: Headers
    http: Headers
    payload: bytes
    offset: int

    @property
    def kind(self) -> str:
        return (self.headers.get("WARC-Type") or "").lower()

    @property
    def length(self) -> int:
        """Of the payload; of a revisit that of the payload it stands for, if its HTTP header says so."""
        said = self.http.get("Content-Length") or ""
        return int(said) if self.kind == "revisit" and said.isdigit() else len(self.payload)


def _clean(value: str) -> str:
    """As a header's value: no line ends."""
    return " ".join(value.split())


def write_record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. For a revisit (refers_to given) the payload isn't written."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": _clean(url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": "sha1:" + payload_digest(block),
        "WARC-Payload-Digest": "sha1:" + digest,
    }
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        headers |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
    headers["Content-Length"] = str(len(block))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head + block + _END) + gz.flush()


def _fields(lines: bytes) -> Headers:
    """Header fields; a line that begins with white space goes on the one before it."""
    out, name = Headers(), None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:
            out[name] = f"{out[name]} {line.decode('utf-8', 'replace').strip()}"
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line has no colon")
        name = key.decode("utf-8", "replace").strip().lower()
        out.setdefault(name, value.decode("utf-8", "replace").strip())
    return out


def _members(archive: bytes, piece: int) -> Iterator[tuple[int, bytes]]:
    """Each gzip member's offset and content, inflated a piece at a time."""
    at = 0
    while at < len(archive):
        begin, inflate, out = at, zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(archive):
                raise WarcError("the last member is cut off")
            part = archive[at : at + piece]
            try:
                out.append(inflate.decompress(part))
            except zlib.error as e:
                raise WarcError(f"member at {begin}: {e}") from None
            at += len(part) - len(inflate.unused_data)
        yield begin, b"".join(out)


def _holds(stated: str, *contents: bytes) -> bool:
    """Whether a stated digest is that of one of the contents; digests of unknown kinds aren't held against anyone."""
    kind, _, value = stated.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    for content in contents:
        made = hashlib.new(kind, content).digest()
        if value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=") or value.lower() == made.hex():
            return True
    return False


def _unchunked(payload: bytes) -> bytes:
    """A payload without its chunked transfer encoding; as it is if it isn't framed so."""
    out, at = [], 0
    while True:
        line, end, _ = payload[at : at + 64].partition(b"\r\n")
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return payload
        at += len(line) + 2
        if not end or at + size > len(payload):
            return payload
        if not size:
            return b"".join(out)
        out.append(payload[at : at + size])
        at += size + 2


def _record(offset: int, data: bytes) -> Record:
    head, gap, rest = data.partition(_END)
    first, _, lines = head.partition(b"\r\n")
    if not gap or not first.startswith(b"WARC/"):
        raise WarcError(f"record at {offset}: no WARC header")
    headers = _fields(lines)
    said = headers.get("Content-Length") or ""
    if not said.isdigit() or rest[int(said) :] != _END:
        raise WarcError(f"record at {offset}: its block isn't as long as its Content-Length")
    block = rest[: int(said)]
    if not _holds(headers.get("WARC-Block-Digest") or "", block):
        raise WarcError(f"record at {offset}: block digest")
    http, payload = Headers(), block
    kind = (headers.get("WARC-Type") or "").lower()
    if (headers.get("Content-Type") or "").lower().startswith("application/http"):
        lines, gap, payload = block.partition(_END)
        try:
            http = _fields(lines.partition(b"\r\n")[2]) if b"\r\n" in lines else Headers()
        except WarcError:
            http, payload = Headers(), block  # not HTTP after all
    if kind == "revisit":
        if payload and (headers.get("WARC-Profile") or "") == REVISIT_PROFILE:
            raise WarcError(f"record at {offset}: a revisit with a payload")
    elif headers.get("WARC-Truncated") is None and not _holds(headers.get("WARC-Payload-Digest") or "", payload, *([_unchunked(payload)] if "chunked" in (http.get("Transfer-Encoding") or "").lower() else [])):
        raise WarcError(f"record at {offset}: payload digest")
    return Record(headers, http, payload, offset)


def read_records(archive: bytes, piece: int = 65536) -> Iterator[Record]:
    """All records of an archive, of whatever type, one at a time."""
    for offset, data in _members(archive, piece):
        yield _record(offset, data)


def _write(archive_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]):
        out, size = [], 0
        for batch in batches:
            for p in batch.to_pylist():
                html = p["html"] or b""
                record = write_record(p["page_id"], p["url"], html, len(html), base64.b32encode(binascii.unhexlify(p["label"])).decode(), p["refers_to"])
                out.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], names=["archive"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    return run


_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]
)


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() else None


def _read(batches):
    for batch in batches:
        for archive in batch["archive"]:
            rows = []
            for r in read_records(archive.as_py()):
                label = r.headers.get("WARC-Payload-Digest")
                label = payload_digest(r.payload) if label is None else label.partition(":")[2]
                rows.append((_number(r.headers.get("X-Page-Id")), r.length, label, r.kind, _number(r.headers.get("X-Refers-To-Page-Id")), r.headers.get("WARC-Target-URI")))
            yield pa.record_batch([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 4 << 20) -> Written:
    """Archives of about archive_bytes each, with all pages: a table of one column, archive (binary)."""
    pages = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    digests = Written(pages.select("page_id", digest.alias("digest"), F.octet_length("html").alias("length")), "payloads").read()
    digests = digests.where(F.col("length") >= min_bytes)
    first = digests.groupBy("digest", "length").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = digests.join(first.drop("n"), ["digest", "length"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = Written(revisits, "revisits").read()
    # the html stays where it is if the revisits are few enough to come to it
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # the digest tells apart rows that share a page_id
    both = pages.withColumn("digest", digest).join(revisits.hint("broadcast" if few else "shuffle_hash"), ["page_id", "digest"], "left")
    return Written(both.select("page_id", "url", "html", "refers_to", F.sha1("html").alias("label")).mapInArrow(_write(archive_bytes), "archive binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of every record, all checked.

    Records of other writers have a null page_id and refers_to, and their own record types; a record that
    states no payload digest gets that of its payload.
    """
    return archives.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """Writes a record for every page and reads the archives back.

    Payload: the html in UTF-8, null as empty. Of records with equal payloads of at least min_bytes bytes
    that with the smallest page_id is the response and the others revisit it; smaller ones are responses.
    A null page_id has a response of its own and is revisited by none. Rows that share the smallest
    page_id and payload are all responses. Other columns are ignored; an empty table gives none.
    """
    archives = write_archives(pages, min_bytes, archive_bytes)
    free_shuffles(pages.sparkSession)
    return read_archives(archives.read()).drop("target_uri")


def export_archives(archives: DataFrame, folder: str) -> int:
    """Write each archive as a .warc.gz file through Hadoop's file systems, one at a time; returns how many."""
    spark = archives.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    n = 0
    for n, row in enumerate(archives.toLocalIterator(), 1):
        path = hadoop.Path(f"{folder}/part-{n:06d}.warc.gz")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytearray(row["archive"]))
        out.close()
    return n


def read_files(spark, folder: str) -> DataFrame:
    """The records of .warc.gz files in a folder. A file is a row, so it must be under 2 GB; the format's usual size is 1 GB."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("content").alias("archive")))

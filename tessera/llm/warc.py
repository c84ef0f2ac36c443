"""WARC archives: a distributed writer, and a Python data source that reads them back.

Writing is DataFrame functions and Spark's own text writer with CRLF as the line end, so any file system that Spark
reaches takes the archives and a lost task is simply written again. Payload digests group equal payloads; the record of
the largest id is the response and the others are revisits without payload.

Reading plans partitions from the files, takes predicates on the record type and the other header columns, parses a
record's headers first and seeks over the block of a record that no predicate wants or whose payload is not asked for.
Small files share a partition, up to `partition_bytes`; a larger plain file is cut into ranges of that size, and a record
belongs to the range that holds its first byte. Each range's task hops from the file's start over headers alone, since a
payload may itself hold what looks like a record. A gzip file is one partition: nothing in it tells where a member ends.

`payload_length` counts the payload bytes that stand in the block, whatever its HTTP head says; `declared_length` is the
Content-Length of that head, null unless it is one plain number. A head may have any size; a block without the empty line
after its head has no payload. A record whose own Content-Length is missing or no plain number has null lengths and no
payload, and reading goes on at the next line that begins with `WARC/`, as it does after a length that is too short; one
that reaches beyond the end of the file takes what is there. A gzip member that is cut short fails the read.

Defined cases: a null payload is empty; of repeated rows with the largest id of their payload all are responses; a null
id is smaller than any other and, where all ids of a payload are null, its rows are responses; line breaks in a URL
become spaces, a null URL is left out; an archive without records gives no rows; other columns are ignored. A payload is
one cell and so must fit a task (below 2 GB); without payloads records of any length are read.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from .common import fits, settled

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, warc_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_length long, declared_length long, payload binary"
#: Header of each column that predicates can be pushed to.
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
BATCH_BYTES = 8 << 20
#: Bytes of a line of an HTTP head, or of a line between records, that are looked at; a field's name and number stand there.
LINE = 64 << 10
NUMBER = re.compile(r"[0-9]{1,18}")


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 SHA-1 of binary or string data."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Payloads that are shared are found on their digests alone. If those are few they are broadcast; otherwise each row's
    verdict is settled first and joined by id, so that no payload is shuffled to where its many copies meet.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    shared = own.groupBy("payload_digest").agg(F.max("id").alias("winner"), F.count("*").alias("copies")).where("copies > 1 and winner is not null").drop("copies")
    shared = settled(shared)
    if fits(shared):
        joined = own.join(F.broadcast(shared), "payload_digest", "left")
    else:
        verdicts = own.select("id", "payload_digest").join(shared, "payload_digest").distinct().withColumnsRenamed({"id": "i", "payload_digest": "d"})
        joined = own.join(verdicts, own.id.eqNullSafe(verdicts.i) & (own.payload_digest == verdicts.d), "left")
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner"))
    return joined.select("id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write(recs: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write `records` to a new folder of WARC files."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    block = F.concat(head, body)

    def field(label: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{label}: "), value, F.lit(CRLF)), F.lit(""))

    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", name("id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), name("refers_to"))),
        field("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(CRLF),
    )
    recs.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


#: File systems that go by another name in Spark than in Arrow.
SAME = {"s3a": "s3", "s3n": "s3"}


def _uri(path: str) -> str | None:
    """The path as Arrow names it; None for a local one."""
    scheme, rest = path.split(":", 1) if ":/" in path else ("", path)
    return None if scheme in ("", "file") else f"{SAME.get(scheme, scheme)}:{rest}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it; an unknown scheme is an error, never a local path."""
    uri = _uri(path)
    if uri is None:
        rest = path.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Files(InputPartition):
    """(path, first byte, byte after the last) of each piece."""

    pieces: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = {EqualTo: "=", In: "in", StringStartsWith: "starts", IsNotNull: "there"}.get(type(f))
            if column in HEADERS and kind:
                self.tests.append((HEADERS[column], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, path = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        plan, shared, held = [], [], 0
        for info in sorted((x for x in found if x.type == pafs.FileType.File and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            if info.size > self.most and not info.path.endswith(".gz"):
                ranges = math.ceil(info.size / self.most)
                plan += [Files([(info.path, info.size * k // ranges, info.size * (k + 1) // ranges)]) for k in range(ranges)]
                continue
            if not shared or held + info.size > self.most:
                shared.append(Files([]))
                held = 0
            shared[-1].pieces.append((info.path, 0, info.size))
            held += info.size
        return plan + shared or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = headers.get(name)
            if own is None or kind == "=" and own != value or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition):
        fs, _ = _open(self.path)
        rows, held = [], 0
        for path, start, end in partition.pieces:
            packed = path.endswith(".gz")
            with fs.open_input_stream(path, compression="gzip") if packed else fs.open_input_file(path) as raw:
                stream = io.BufferedReader(raw, 1 << 20 if packed or self.payload and not start else 16 << 10)
                for row in _records(stream, self, None if packed else raw.size(), start, end):
                    rows.append(row)
                    held += 512 + len(row[-1] or b"")
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _fields(stream) -> dict[str, str]:
    """The header lines up to the empty one; a line that begins with white space continues the last."""
    out, last = {}, None
    while line := stream.readline().rstrip(b"\r\n").decode("utf-8", "replace"):
        if line[0] in " \t" and last:
            out[last] += " " + line.strip()
        else:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _number(text: str) -> int | None:
    return int(text) if NUMBER.fullmatch(text) else None


def _line(stream, most: int | None = None) -> tuple[bytes, int]:
    """The next line, cut to LINE bytes, and how many bytes of the stream it takes; at most `most`."""
    line = stream.readline(LINE if most is None else min(LINE, most))
    size, ended = len(line), line.endswith(b"\n")
    while size and not ended and (most is None or size < most):
        more = stream.readline(LINE if most is None else min(LINE, most - size))
        if not more:
            break
        size, ended = size + len(more), more.endswith(b"\n")
    return line, size


def _http_head(stream, size: int) -> tuple[int, int | None]:
    """Bytes of the head of a block of `size` bytes, the empty line included, and the one length that it declares."""
    read, declared = 0, []
    while read < size:
        line, taken = _line(stream, size - read)
        read += taken
        if not taken or not line.strip(b"\r\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            declared.append(value.strip().decode("utf-8", "replace"))
    return read, _number(declared[0]) if len(declared) == 1 else None


def _records(stream, reader: WarcReader, file_size: int | None, start: int, end: int) -> Iterator[tuple]:
    """The wanted records that begin from `start` up to `end`; file_size is None for a stream that can't seek."""
    while True:
        at = stream.tell() if file_size is not None else start
        line, taken = _line(stream)
        if not taken or at >= end and file_size is not None:
            return
        if not line.startswith(b"WARC/"):  # empty lines between records, and what a bad length leaves behind
            continue
        headers = _fields(stream)
        size = _number(headers.get("content-length", ""))
        want = at >= start and reader.wanted(headers)
        if size is None:
            if want:
                yield (*(headers.get(x) for x in HEADERS.values()), None, None, None)
            continue
        if file_size is not None:
            size = min(size, file_size - stream.tell())
        if not want:
            _skip(stream, size, file_size is not None)
            continue
        head, declared = _http_head(stream, size) if "application/http" in headers.get("content-type", "") else (0, None)
        if reader.payload and headers.get("warc-type") != "revisit":
            data = stream.read(size - head)
            length = len(data)
        else:
            data, length = None, _skip(stream, size - head, file_size is not None)
        yield (*(headers.get(x) for x in HEADERS.values()), length, declared, data)


def _skip(stream, size: int, seekable: bool) -> int:
    """Passes over `size` bytes; the number of those that were there."""
    if seekable:
        stream.seek(size, io.SEEK_CUR)
        return size
    left = size
    while left > 0 and (got := len(stream.read(min(left, 1 << 20)))):
        left -= got
    return size - left


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.int64(), pa.binary()]
    names = [*HEADERS, "payload_length", "declared_length", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path)"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    """The records under `path`, with SCHEMA's columns."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(path)

"""Positioned words of documents as a data source: files in, one row a word out, unwanted pages passed over unread.

A file holds a document's pages one after another. A page begins with a line `\\f<page> <bytes>` that says how many bytes
of word lines follow, each `y<TAB>x0<TAB>x1<TAB>text`; so a reader that does not want a page goes on behind it without
taking it apart. Pages are planned as partitions: the files' page lines are read once, hopping from one to the next, and
pages next to each other are put together up to `partition_bytes`. Equality, membership and bounds on `page` are settled in
the plan, so that pages outside them are never opened; bounds on `y` (a band of rows) are tested before a word is made.

Files lie on any file system that Arrow reaches (local paths, file:, hdfs:, s3:; s3a: and s3n: are read as s3:).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "document string, page int, y double, x0 double, x1 double, text string"
TYPES = pa.schema([("document", pa.string()), ("page", pa.int32()), ("y", pa.float64()), ("x0", pa.float64()), ("x1", pa.float64()), ("text", pa.string())])
#: File systems that go by another name in Spark than in Arrow.
SAME = {"s3a": "s3", "s3n": "s3"}
BOUNDS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}
#: Words in one batch.
WORDS = 50_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    scheme, rest = path.split(":", 1) if ":/" in path else ("file", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return pafs.FileSystem.from_uri(f"{SAME.get(scheme, scheme)}:{rest}")


@dataclass
class Pages(InputPartition):
    """(path, page, first byte, bytes) of each page."""

    of: list[tuple[str, int, int, int]]


class WordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("partition_bytes", 8 << 20))
        self.pages: list[tuple] = []
        self.bands: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in BOUNDS and column in ("page", "y"):
                (self.pages if column == "page" else self.bands).append((BOUNDS[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        fs, path = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        plan, held = [], 0
        for info in sorted((x for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            for page, start, size in _page_lines(fs, info.path):
                if not all(holds(page, value) for holds, value in self.pages):
                    continue
                if not plan or held + size > self.most:
                    plan.append(Pages([]))
                    held = 0
                plan[-1].of.append((info.path, page, start, size))
                held += size
        return plan or [Pages([])]

    def read(self, partition):
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        for path, page, start, size in partition.of:
            name = path.rsplit("/", 1)[-1]
            with fs.open_input_file(path) as file:
                file.seek(start)
                data = file.read(size)
            for line in data.split(b"\n"):
                if not line:
                    continue
                y, x0, x1, text = line.split(b"\t", 3)
                height = float(y)
                if all(holds(height, value) for holds, value in self.bands):
                    rows.append((name, page, height, float(x0), float(x1), text.decode("utf-8", "replace")))
                if len(rows) >= WORDS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES.types, strict=True)], schema=TYPES)


def _page_lines(fs: pafs.FileSystem, path: str):
    """(page, first byte of its words, bytes of them) of each page of a file."""
    with fs.open_input_file(path) as file:
        end, at = file.size(), 0
        while at < end:
            file.seek(at)
            head = file.read(64)
            line = head.split(b"\n", 1)[0]
            if not line.startswith(b"\f"):
                raise ValueError(f"{path}: no page begins at byte {at}")
            page, size = map(int, line[1:].split())
            yield page, at + len(line) + 1, size
            at += len(line) + 1 + size


class WordSource(DataSource):
    """spark.read.format("words").load(path)"""

    @classmethod
    def name(cls):
        return "words"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WordReader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("words").options(**options).load(path)


def write(words: DataFrame, path: str, files: int = 8) -> None:
    """Write words(page, y, x0, x1, text) as a folder of such files; a page lies in one file, its words in order.

    White space inside a text becomes a space.
    """
    plain = F.regexp_replace("text", r"[\t\n\r\f]", " ")
    line = F.concat_ws("\t", F.col("y").cast("string"), F.col("x0").cast("string"), F.col("x1").cast("string"), plain)
    lines = words.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1", line.alias("line")))).alias("of"))
    body = F.array_join(F.transform("of", lambda w: w["line"]), "\n")
    head = F.concat(F.lit("\f"), F.col("page").cast("string"), F.lit(" "), (F.octet_length("body") + 1).cast("string"), F.lit("\n"))
    text = lines.withColumn("body", body).select("page", F.concat(head, F.col("body")).alias("value"))
    text.repartitionByRange(files, "page").sortWithinPartitions("page").select("value").write.mode("overwrite").text(path)

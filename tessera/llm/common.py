"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that it survives lost executors and has no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark has for it; nothing happens if it is gone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes up to which a table is broadcast; each row counts ROW bytes and its strings and binaries.
BROADCAST_BYTES, ROW = 64 << 20, 64


def fits(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` is measured to take at most `most_bytes` when broadcast."""
    sizes = [F.coalesce(F.octet_length(f"`{c}`").cast("long"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return (df.agg(F.sum(sum(sizes, F.lit(ROW)).cast("long"))).first()[0] or 0) <= most_bytes


def small_or_plain(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it `fits`; otherwise unchanged (a shuffled join). It is computed for both uses."""
    return F.broadcast(df) if fits(df, most_bytes) else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(docs: DataFrame, keep: list[str], text_col: str, fn: Callable, schema: str, most_bytes: int = 4 << 20) -> DataFrame:
    """Apply `fn(texts: list[bytes], table: pa.RecordBatch) -> pa.RecordBatch` to Arrow batches of UTF-8 texts; null is empty.

    Only the columns in `keep` and the text are read, so other columns may have any name.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most_bytes):
                texts = [x or b"" for x in piece.column(piece.num_columns - 1).cast(pa.binary()).to_pylist()]
                out = fn(texts, piece)
                if out is not None and out.num_rows:
                    yield out

    return src.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most_bytes` of text each (one row at least), to bound memory."""
    col = batch.column(batch.num_columns - 1)
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)

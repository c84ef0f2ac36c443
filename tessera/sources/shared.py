"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
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
    """`df` computed once and kept in the shared folder: without lineage, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes up to which a table is broadcast; each row counts ROW bytes and its strings and binaries.
BROADCAST_BYTES, ROW = 64 << 20, 64


def small_or_plain(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is measured to take at most `most_bytes`; otherwise unchanged (a shuffled join)."""
    sizes = [F.coalesce(F.octet_length(f"`{c}`").cast("long"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    taken = df.agg(F.sum(sum(sizes, F.lit(ROW)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= most_bytes else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark has for it; nothing happens if it is gone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

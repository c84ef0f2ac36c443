"""The archive as a stream: state by address across micro-batches, so that only new content becomes a new version.

For each address the digests that it has had are kept. What arrives is looked at in the order of its time: equal content
gives nothing, whenever it comes again; other content is the next version. A replay of files therefore adds nothing, and
all versions together are those of `files.archive_versions` over the whole history, as long as each address's fetches
arrive in the order of their time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import files

VERSIONS = "url string, sha256 string, fetched_at long, version_no long"


def versions(fetched: DataFrame) -> DataFrame:
    """The stream of new versions (url, sha256, fetched_at, version_no) of a stream of fetches (url, sha256, fetched_at)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["fetched_at", "sha256"], kind="stable")
        out = []
        for digest, at in zip(rows["sha256"].tolist(), rows["fetched_at"].tolist(), strict=True):
            if digest not in known:
                known.append(digest)
                out.append((key[0], digest, at, len(known)))
        state.update((known,))
        yield pd.DataFrame(out, columns=["url", "sha256", "fetched_at", "version_no"])

    plain = fetched.select("url", "sha256", F.col("fetched_at").cast("long").alias("fetched_at"))
    return plain.groupBy("url").applyInPandasWithState(step, VERSIONS, "known array<string>", "append", "NoTimeout")


def start(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, once: bool = True, files_a_batch: int = 1) -> StreamingQuery:
    """Read Parquet files of fetches that arrive in `source`, oldest first; new versions go to `store/versions`, by batch, and
    the manifest, one row an address, is the next state of `store/manifest`."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/versions/batch={number}")
        files.update_manifest(spark, f"{store}/manifest", batch, ["url"], number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    out = versions(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()

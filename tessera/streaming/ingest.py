"""Continuous ingestion: each micro-batch of observation files goes through the idempotent upsert.

An extension of the batch model: a new edition is a plain insert there too, so a replayed micro-batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.upsert import upsert


def start(spark: SparkSession, source: str, schema: StructType, store: str, quarantine: str, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """Read Parquet files that arrive in `source`; append new observations to `store`, contradictions to `quarantine`.

    Each micro-batch overwrites folders of its own number in both, so one that failed half way and is run again leaves
    nothing twice; what it compares with are the batches before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        names = [f"`{x}`" for x in schema.fieldNames()]
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/batch=-1")  # so that there is a store
        stored = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(store).where(F.col("batch") < number)
        fresh, collisions = upsert(stored.select(*names), batch, order)
        collisions.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")  # before the store grows, which would hide first values
        fresh.select(*names).write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

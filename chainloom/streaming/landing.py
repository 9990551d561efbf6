"""Incremental runs: files that land in a folder go through the batch plans, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chainloom.functions.schema import strings


def follow(spark: SparkSession, folder: str, names: list[str], transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, sep: str = "\t") -> StreamingQuery:
    """Append transform's rows of newly landed delimited files to out as Parquet; the checkpoint knows what is done.

    Each micro-batch is written under its own number, overwriting what a failed attempt at it left, so every file's rows
    are there exactly once.
    """
    stream = spark.readStream.schema(strings(names)).options(sep=sep, header=True, quote='"', escape='"').csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.na.fill("")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

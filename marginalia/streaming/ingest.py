"""Cleaning new raw rows as they arrive.

Normalising, gating and rendering look at one row at a time, so the batch functions run on a stream unchanged. What
needs the whole corpus (dedup, splits, quotas) stays a batch job over the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def watch_folder(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def clean_into(
    stream: DataFrame, clean: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, partition_by: Sequence[str] = ("split",)
) -> DataStreamWriter:
    """Writer that cleans each batch of rows into a corpus partitioned by split. The checkpoint makes it exactly-once."""
    return (
        clean(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*partition_by)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def clean_available(
    spark: SparkSession,
    source: str,
    clean: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    schema: StructType | str | None = None,
    partition_by: Sequence[str] = ("split",),
    files_per_batch: int | None = None,
) -> None:
    """Clean the files of a folder that no run with this checkpoint has seen, and stop.

    A run that was stopped half-way, or lost its driver, goes on where the checkpoint is: files it had committed are not read
    again, a batch that it had begun is written anew and the log in ``path`` names only what was committed.
    """
    if schema is None:
        schema = spark.read.parquet(source).schema
    stream = watch_folder(spark, source, schema, files_per_batch=files_per_batch)
    clean_into(stream, clean, path, checkpoint, partition_by).trigger(availableNow=True).start().awaitTermination()

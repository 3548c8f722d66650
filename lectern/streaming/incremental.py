"""Row-local preparation that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def run_incremental(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    *,
    source_format: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Process the files that came since the last run, then stop.

    ``transform`` must be row-local: formatting, extraction, encoding, filters, generation, rewards.
    Shuffling, caps and numbering need the whole table. What is done is kept in ``checkpoint``, in the
    shared folder: a run that was stopped, or lost executors, repeats at most the batch it was in, and
    the file sink shows each batch once. Give ``max_files`` to bound a batch.
    """
    reader = spark.readStream.format(source_format).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = transform(reader.load(path)).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

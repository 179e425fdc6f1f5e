"""Incremental ingest of arriving files with a checkpointed file-source stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest_new_files(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None, glob: str | None = None, max_files: int | None = None,
) -> None:
    """Append every file not seen by an earlier call to `out`, then stop.

    The checkpoint remembers finished files and the sink's log makes a retried batch
    idempotent, so a rerun, or a run that lost its executors, adds nothing twice.
    """
    reader = spark.readStream.schema(schema)
    for key, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", max_files)):
        if value is not None:
            reader = reader.option(key, value)
    stream = reader.parquet(source)
    if transform is not None:
        stream = transform(stream)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()

"""Metric windows over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.values import utc_instant
from shelfmark.operators.counts import metric_windows


def stream_metric_windows(
    stream: DataFrame,
    *,
    lateness: str = "10 minutes",
    time: str = "ts",
    service: str = "service",
    value: str = "value",
    width: str = "1 minute",
) -> DataFrame:
    """The batch windows on a stream; a window comes out once it is ``lateness`` past.

    A watermark needs an instant; a zone-less time is taken as UTC.
    """
    timed = stream.withColumn(time, utc_instant(stream, time))
    return metric_windows(
        timed.withWatermark(time, lateness), time=time, service=service, value=value, width=width
    )


def run_metric_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    target: str,
    checkpoint: str,
    *,
    files_per_trigger: int | None = None,
    **windows: str,
) -> StreamingQuery:
    """Work off all Parquet files not seen before, then stop. Append output, restartable.

    All new files make one batch unless ``files_per_trigger`` is set. Between batches the
    watermark moves, so with a limit the files have to come about in order of time:
    what is later than ``lateness`` is dropped, as on any stream.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (
        stream_metric_windows(reader.parquet(source), **windows)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Scenes and subtitle lines as streams: every record once, appended to the tables the batch plans read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once_in_stream(stream: DataFrame, keys: list[str], time: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """The first delivery of each key; a key is remembered for ``late`` after its time, so the state stays bounded."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, partition: str = "video", available_now: bool = True) -> StreamingQuery:
    """Writes every batch of ``stream`` below ``path`` by ``partition``, after ``prepare`` (an encoder, say).

    A batch has a folder of its own, which a second run of the same batch replaces: each row is there once even if the
    job broke off.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def line_rates(stream: DataFrame, window: str = "1 hour", late: str = "7 days", time: str = "ingested_at") -> DataFrame:
    """Lines and videos delivered in each window; a window is given once nothing may come to it any more."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, window)).agg(F.count("*").alias("n_lines"), F.approx_count_distinct("video").alias("n_videos"))

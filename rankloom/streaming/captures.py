"""Captures that arrive in a folder, turned into players as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import process
from ..sources.captures import stream_captures


def stream_players(spark: SparkSession, source: str, target: str, checkpoint: str, override: str | None = None, once: bool = False) -> StreamingQuery:
    """Append the players of new capture files below ``source`` to ``target``, one folder for each micro-batch.

    A batch that is run again after a failure overwrites its own folder, so every file counts once. ``once`` ends the
    query when all files that are there have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("capture_id", F.col("source_file"))
        process(named, override=override).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream_captures(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="10 seconds")).start()

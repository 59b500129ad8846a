"""The op log as a stream (an extension): each micro-batch is reduced and merged into the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltlog.operators import oplog


def changelog(log_stream: DataFrame) -> DataFrame:
    """key, seq, op, value: the deciding row of each key so far, as an update-mode aggregate of the stream."""
    won = log_stream.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    return won.select("key", "w.seq", "w.op", "w.value")


def write_changelog(log_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's changed keys to Parquet; ``read_state`` reduces what was written.

    A batch that is written again after a failure repeats rows with the same seq, which changes no result.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    return changelog(log_stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()


def read_state(written: DataFrame) -> DataFrame:
    """key, value of the live keys of a written changelog."""
    return oplog.live_state(written)

"""Searches over streams: matching keeps no state between rows, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from oreline.operators.search import Search


def stream_matches(stream: DataFrame, search: Search, key: list[str], text: str, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the matches of each micro-batch to parquet files in ``folder``.

    Micro-batches run the batch search, whose choice among hits of a word is a window within a row of
    the stream; a batch that is run again after a failure overwrites its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        search.match(batch, key, text).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

"""Reads that arrive as a stream, encoded a micro-batch at a time (an extension: bounded input is the usual case)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks
from ..operators.chunks import Options


def encode_stream(reads: DataFrame, target: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Append the streams of each micro-batch's chunks to target/streams/batch=<id>.

    A chunk must not span micro-batches. A batch that is repeated after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        chunks.encoded(batch, options).write.mode("overwrite").parquet(f"{target}/streams/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Files as they arrive: a stream over the library's folder that keeps the chunk table fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunker import chunk
from ..sources.files import read_stream, segments_of


def refresh(spark: SparkSession, folder: str, target: str, state: str, size: int = 900, overlap: int = 120) -> StreamingQuery:
    """Reads new files of ``folder``, cuts them into chunks and appends them under ``target``; ``state`` is the stream's checkpoint.

    A batch that is repeated after a failure overwrites its own part and no other, so chunks are written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        segments = segments_of(batch)
        chunk(segments, size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return read_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()

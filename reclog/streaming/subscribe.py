"""Subscriptions over a store: catch up from a cursor in bounded batches, then follow what is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads
from ..sources.store import RecordStore


class StreamNotFoundError(Exception):
    pass


def subscribe(spark: SparkSession, path: str, stream: str, start: int, files_a_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of the stream's records from sequence start; the query's checkpoint holds the cursor.

    Raises StreamNotFoundError for a stream without records; the first read does not wait for one.
    """
    now = spark.read.parquet(path)
    if now.where(F.col("stream") == stream).isEmpty():
        raise StreamNotFoundError(stream)
    live = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return live.where((F.col("stream") == stream) & (F.col("sequence") >= start))


class Cursor:
    """A subscription with its cursor in the caller's hands: sequence is the next record that it wants.

    step() gives one batch of at most max_records records and max_bytes bytes in order, and moves the cursor past what
    `take` was given without an error; a batch whose take fails comes again, so delivery is at least once. At the tail
    it gives nothing and leaves the cursor, which is all a heartbeat says.
    """

    def __init__(self, store: RecordStore, stream: str, start: int = 0, max_records: int = 1000, max_bytes: int = 4 << 20):
        self.store, self.stream, self.sequence, self.max_records, self.max_bytes = store, stream, start, max_records, max_bytes
        self.closed = False
        if store.extents().where(F.col("stream") == stream).isEmpty():
            raise StreamNotFoundError(stream)

    def step(self, take: Callable[[DataFrame], None]) -> int:
        """Records taken. Raises ValueError if one record alone exceeds max_bytes, or if the subscription is closed."""
        if self.closed:
            raise ValueError("the subscription is drained")
        ask = self.store.spark.createDataFrame([(0, self.stream, self.sequence, self.max_records, self.max_bytes)], "request long, stream string, from_sequence long, max_records long, max_bytes long")
        near = self.store.read(self.stream, self.sequence, self.max_records, 1 << 62)
        if near.isEmpty():
            return 0
        answer = reads.answers(ask, near).first()
        if answer["outcome"] != "OK":
            raise ValueError(f"{answer['outcome']}: {answer['required_bytes']} bytes")
        take(near.where(F.col("sequence") < answer["next_sequence"]).orderBy("sequence"))
        self.sequence = answer["next_sequence"]
        return answer["records"]

    def drain(self) -> None:
        self.closed = True
